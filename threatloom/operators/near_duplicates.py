"""Groups of near-duplicate texts: exact cosine on character grams, without listing all pairs of a group."""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dimensions as D
from ..functions.text import blank_words
from ..sources.shared import checkpointed, rows_a_batch
from .components import components

GRAM = 5
#: Characters and texts of a tile at most, and characters from which a label takes more than one tile, up to FEW.
TILE_CHARS, TILE_TEXTS, SMALL_CHARS, FEW = 16_000_000, 4096, 1_000_000, 8
#: Shelves of a label, as far as it has tiles, and tiles of a shelf at most where this takes more shelves.
SHELVES, SHELF_TILES = 4, 16
#: Partitions of tiles at most; with more tiles, several share one.
PARTS = 10_000
#: Vectors handed on at a time.
VECTORS = 256
#: Columns of the first product, sets of the other columns, and rows of a block.
HEAD, RESTS, BLOCK = 2048, 1024, 1024
#: More than rounding can take from a bound in single precision.
SLACK = 1e-4


def word_grams(word: str) -> list[str]:
    """The grams of one word, as ``char_wb_grams`` cuts them."""
    p = f" {word} "
    return [p[i:i + GRAM] for i in range(max(len(p) - GRAM + 1, 1))]


def pack(numbers) -> bytes:
    """Small numbers, bytes of equal weight together, compressed."""
    return zlib.compress(np.asarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


class Counts:
    """Gram counts of the texts of one tile; grams are numbered as they come."""

    def __init__(self, n: int):
        self.n, self.terms, self.words = n, {}, {}
        self.docs, self.sizes, self.idx, self.tf = [], [], [], []

    def grams(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is None:
            known = self.words[word] = np.array([self.terms.setdefault(g, len(self.terms)) for g in word_grams(word)], np.int32)
        return known

    def add(self, doc: int, words: list | None) -> None:
        times = Counter(words or [])
        parts = [self.grams(w) for w in times]
        at, back = np.unique(np.concatenate(parts), return_inverse=True) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.docs.append(doc)
        self.sizes.append(len(at))
        self.idx.append(at.astype(np.int32))
        self.tf.append(np.bincount(back, np.repeat(list(times.values()), [len(p) for p in parts])).astype(np.int32) if parts else at)

    def row(self, key: tuple) -> pa.RecordBatch:
        """Grams are numbered anew, frequent ones first, which packs better."""
        idx, terms = np.concatenate(self.idx), list(self.terms)
        seen = np.bincount(idx, minlength=len(terms))
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        places = np.repeat(np.arange(len(self.sizes)) * len(terms), self.sizes) + rank[idx]
        at = np.argsort(places)
        values = [key[0], key[1], self.n, self.docs, pack(self.sizes), pack(np.diff(rank[idx[at]], prepend=0)), pack(np.concatenate(self.tf)[at]),
                  [terms[i] for i in order], seen[order].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, COUNTED.types)], schema=COUNTED)


COUNTED = pa.schema([("label", pa.string()), ("tile", pa.int32()), ("n", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("idx", pa.binary()),
                     ("tf", pa.binary()), ("terms", pa.list_(pa.string())), ("seen", pa.list_(pa.int64()))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tiles: dict = {}
    for batch in batches:
        for label, tile, n, doc, words in zip(*(batch.column(c).to_pylist() for c in ("label", "tile", "n", "doc", "words"))):
            key = label, tile
            if key not in tiles:
                tiles[key] = Counts(n)
            tiles[key].add(doc, words)
    while tiles:
        key, counts = tiles.popitem()
        yield counts.row(key)


class Tile:
    """Unit TF-IDF vectors of the texts of a tile, row by row."""

    def __init__(self, n: int, docs: list, sizes: bytes, idx: bytes, tf: bytes, terms: list, df: np.ndarray):
        self.docs, self.terms = docs, terms
        sizes, idx, tf = unpack(sizes), np.cumsum(unpack(idx), dtype=np.int32), unpack(tf)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        kept = df[idx] >= 2
        self.rows, self.idx = rows[kept], idx[kept]
        w = tf[kept] * (np.log((1 + n) / (1 + df[self.idx])) + 1)
        self.df, self.raw = df, w
        self.w = w / np.sqrt(np.bincount(self.rows, w * w, len(sizes)))[self.rows]
        self.start()

    def start(self) -> None:
        self.ptr = np.searchsorted(self.rows, np.arange(len(self.docs) + 1))

    def in_columns_of(self, other: "Tile") -> "Tile":
        """The same rows over the terms of another tile; terms unknown there, which meet nothing, are left out."""
        at = {t: i for i, t in enumerate(other.terms)}
        column = np.array([at.get(t, -1) for t in self.terms], np.int32)[self.idx]
        out = object.__new__(Tile)
        out.docs, out.terms = self.docs, other.terms
        out.rows, out.idx, out.w = self.rows[column >= 0], column[column >= 0], self.w[column >= 0]
        out.start()
        return out

    def energy(self) -> np.ndarray:
        return np.bincount(self.idx, self.w * self.w, len(self.terms))

    def lead(self, place: np.ndarray) -> np.ndarray:
        """The columns placed below HEAD, then the norms of those that share a place from HEAD on."""
        at = place[self.idx]
        head, rest = (at >= 0) & (at < HEAD), at >= HEAD
        norms = np.bincount(self.rows[rest] * RESTS + at[rest] - HEAD, self.w[rest] ** 2, len(self.docs) * RESTS)
        out = np.zeros((len(self.docs), HEAD + RESTS), np.float32)
        out[self.rows[head], at[head]] = self.w[head]
        out[:, HEAD:] = np.sqrt(norms.reshape(-1, RESTS))
        return out

    def products(self, vector: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whole products of a vector over all columns with these rows, none of which is empty."""
        own = [slice(a, b) for a, b in zip(self.ptr[rows].tolist(), self.ptr[rows + 1].tolist())]
        lengths = self.ptr[rows + 1] - self.ptr[rows]
        idx, w = np.concatenate([self.idx[x] for x in own]), np.concatenate([self.w[x] for x in own])
        return np.add.reduceat(vector.take(idx) * w, np.cumsum(lengths) - lengths)


def links(x: Tile, y: Tile, part: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(row of x, row of y, cosine): links that join what part, the components of the rows of x and then y, holds apart; part is kept up.

    Leading columns are multiplied first; what the others, in RESTS sets, add to
    a product is at most the products of the norms there. Pairs that this cannot decide, and whose
    rows are not yet in one component, get their whole product.
    """
    same = x is y
    shift = 0 if same else len(x.docs)
    ex, ey = x.energy(), y.energy()
    shared = (ex > 0) & (ey > 0)
    order = np.argsort(-(ex * ey), kind="stable")[:int(shared.sum())]
    place, rank = np.full(len(ex), -1, np.int32), np.arange(len(order))
    place[order] = np.where(rank < HEAD, rank, HEAD + rank % RESTS)
    lx = x.lead(place)
    ly = lx if same else y.lead(place)
    vector = np.zeros(len(ex))
    for i in range(0, len(lx), BLOCK):
        for j in range(i if same else 0, len(ly), BLOCK):
            a, b = np.nonzero(lx[i:i + BLOCK] @ ly[j:j + BLOCK].T >= threshold - SLACK)
            a, b = a + i, b + j
            open_ = (part[a] != part[b + shift]) & ((a < b) | (not same))
            a, b = a[open_], b[open_]
            cuts = np.flatnonzero(np.diff(a, prepend=-1))
            for u, others in zip(a[cuts].tolist(), np.split(b, cuts[1:])):
                others = others[part[others + shift] != part[u]]
                if not len(others):
                    continue
                own = slice(x.ptr[u], x.ptr[u + 1])
                vector[x.idx[own]] = x.w[own]
                cosine = y.products(vector, others)
                vector[x.idx[own]] = 0
                others, cosine = others[cosine >= threshold - 1e-9], cosine[cosine >= threshold - 1e-9]
                met, first = np.unique(part[others + shift], return_index=True)
                if len(met):
                    yield from zip([u] * len(met), others[first].tolist(), cosine[first].tolist())
                    part[np.isin(part, met)] = part[u]


def _made(b: pa.RecordBatch, i: int, end: str = "") -> Tile:
    cell = lambda c: b.column(c + end)[i]
    return Tile(b.column("n")[i].as_py(), cell("docs").as_py(), cell("sizes").as_py(), cell("idx").as_py(), cell("tf").as_py(), cell("terms").as_py(), unpack(cell("df").as_py()))


def _with_df(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
    """One row with the document frequencies of its grams in place of those that are known."""
    known = batch.column("known")[i].values
    df = np.zeros(len(batch.column("terms")[i]), np.int32)
    df[known.field("i").to_numpy()] = known.field("df").to_numpy()
    return batch.drop_columns(["known"]).slice(i, 1).append_column("df", pa.array([pack(df)], pa.binary()))


def _inner(threshold: float):
    """The links of a tile with itself, and the components that they make of its rows."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = _with_df(batch, i)
                tile = _made(row, 0)
                part = np.arange(len(tile.docs), dtype=np.int32)
                found = [(tile.docs[u], tile.docs[v], c) for u, v, c in links(tile, tile, part, threshold)]
                yield row.append_column("part", pa.array([pack(part)], pa.binary())).append_column("links", pa.array([_edges(found)], LINKS))
    return run


LINKS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())]))


def _edges(found: list) -> list:
    """Links of texts that have a name and not the same one, the smaller first."""
    return [{"a": min(a, b), "b": max(a, b), "cosine": c} for a, b, c in found if a is not None and b is not None and a != b]


def met_here(a: int, b: int, shelves: int, p: int, q: int) -> bool:
    """Whether shelves p and q decide about tiles a and b: from two shelves, or from one of them, which goes with the next shelf."""
    x, y = a % shelves, b % shelves
    return a < b and sorted((x, (x + 1) % shelves if x == y else y)) == [p, q]


def _outer(threshold: float):
    """The links between tiles of two shelves, and of one with itself, that join components of two tiles; two tiles are unpacked at a time.

    A partition is one pair of shelves.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("tile")
        label, p, q, shelves = (table.column(c)[0].as_py() for c in ("label", "p", "q", "shelves"))
        tile = table.column("tile").to_pylist()
        out = []
        for i in range(len(tile)):
            x = None
            for j in range(len(tile)):
                if met_here(tile[i], tile[j], shelves, p, q):
                    x, y = x or _made(table, i), _made(table, j)
                    px, py = (unpack(table.column("part")[k].as_py()) for k in (i, j))
                    part = np.concatenate((px, py + len(px)))
                    out.append(_edges([(x.docs[u], y.docs[v], c) for u, v, c in links(x, y.in_columns_of(x), part, threshold)]))
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(out), pa.string()), pa.array(out, LINKS)], ["label", "links"])
    return run


TILE = "label string, tile int, n bigint, docs array<bigint>, sizes binary, idx binary, tf binary, terms array<string>"


def counted_tiles(texts: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One row a tile: its texts' gram counts, and the document frequencies, in the label, of its grams that two texts or more have.

    Texts of a label are dealt to tiles by hash, and each tile is a partition of
    its own. Only a tile's distinct grams are counted over all tiles.
    """
    source = f"substring(text, 1, {max_chars})" if max_chars else "text"
    sizes = texts.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.expr(f"length({source})")).alias("c")).selectExpr(
        "label", "n", f"greatest(ceil(n / {TILE_TEXTS}), ceil(coalesce(c, 0) / {TILE_CHARS}), least({FEW}, ceil(coalesce(c, 0) / {SMALL_CHARS})), 1) AS k")
    # One row a label.
    sizes = checkpointed(sizes.selectExpr("*", "sum(k) OVER (ORDER BY label) - k AS first"))
    total = sizes.agg(F.sum("k")).first()[0] or 1
    dealt = texts.join(F.broadcast(sizes), "label").selectExpr("label", "int(pmod(xxhash64(doc), k)) AS tile", "n", "bigint(doc) AS doc", f"{source} AS text", "first")
    parts = min(total, PARTS)
    dealt = dealt.repartitionById(parts, F.expr(f"int((first + tile) % {parts})")).drop("first")
    words = dealt.selectExpr("label", "tile", "n", "doc", f"{blank_words('text')} AS words")
    with rows_a_batch(texts.sparkSession, 256):
        counted = checkpointed(words.mapInArrow(_counted, f"{TILE}, seen array<bigint>"))
    seen = counted.selectExpr("label", "tile", "posexplode(arrays_zip(terms, seen)) AS (i, x)").selectExpr("label", "tile", "i", "x.terms AS term", "x.seen AS seen")
    df = seen.withColumn("df", F.sum("seen").over(Window.partitionBy("label", "term"))).where("df >= 2")
    known = df.groupBy("label", "tile").agg(F.collect_list(F.struct("i", "df")).alias("known"))
    return counted.drop("seen").join(known, ["label", "tile"])


def tiles(texts: DataFrame, threshold: float, max_chars: int | None = None) -> DataFrame:
    """One row a tile: its texts' gram counts, the document frequencies of its grams in the label, its inner links and components."""
    with rows_a_batch(texts.sparkSession, 1):
        return checkpointed(counted_tiles(texts, max_chars).mapInArrow(
            _inner(threshold), f"{TILE}, df binary, part binary, links array<struct<a: bigint, b: bigint, cosine: double>>"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of the texts of a tile, some at a time; texts of one id share one vector."""
    for batch in batches:
        for row in range(batch.num_rows):
            made = _made(_with_df(batch, row), 0)
            ids: dict = {}
            at = np.array([ids.setdefault(d, len(ids)) for d in made.docs], np.int64)[made.rows]
            w = made.raw / np.sqrt(np.bincount(at, made.raw * made.raw, len(ids)))[at]
            terms, df = pa.array(made.terms, pa.string()), made.df
            rank = np.empty(len(terms), np.int64)
            rank[sorted(range(len(terms)), key=made.terms.__getitem__)] = np.arange(len(terms))
            order = np.lexsort((w, rank[made.idx], df[made.idx], at))
            at, idx, w = at[order], made.idx[order], w[order]
            ends, docs = np.searchsorted(at, np.arange(len(ids) + 1)), list(ids)
            for a in range(0, len(ids), VECTORS):
                b = min(a + VECTORS, len(ids))
                own = slice(ends[a], ends[b])
                cells = pa.StructArray.from_arrays([pa.array(df[idx[own]].astype(np.int64)), terms.take(pa.array(idx[own])), pa.array(w[own])], ["df", "term", "w"])
                v = pa.ListArray.from_arrays(pa.array(ends[a:b + 1] - ends[a], pa.int32()), cells)
                label = pa.array([batch.column("label")[row].as_py()] * (b - a), pa.string())
                out = pa.RecordBatch.from_arrays([label, pa.array(docs[a:b], pa.int64()), v], ["label", "doc", "v"])
                yield out.filter(pa.array(np.diff(ends[a:b + 1]) > 0))


def gram_vectors(texts: DataFrame, max_chars: int | None = None) -> DataFrame:
    """texts(doc, label, text) -> (label, doc, v): unit TF-IDF vectors of 5-grams seen in two texts or more, per label.

    v has df, term and weight of each gram, rarest first. A text without such a
    gram has no row. Vectors are far larger than their texts and not stored.
    """
    return counted_tiles(texts, max_chars).mapInArrow(_vectors, "label string, doc bigint, v array<struct<df: bigint, term: string, w: double>>")


def meetings(made: DataFrame) -> DataFrame:
    """A row for each tile and pair (p, q) of its shelf with another one, of labels with more than one tile.

    Each pair of shelves is a partition of its own, large labels first: a hash
    lays several on one partition and leaves others empty.
    """
    shelved = checkpointed(made.groupBy("label").agg((F.max("tile") + 1).alias("k"))).where("k > 1").selectExpr(
        "label", "k", f"int(least(k, greatest({SHELVES}, ceil(k / {SHELF_TILES})))) AS shelves")
    placed = made.drop("links").join(F.broadcast(shelved.drop("k")), "label").selectExpr("*", "tile % shelves AS shelf")
    sent = placed.selectExpr("*", "explode(filter(sequence(0, shelves - 1), x -> x <> shelf)) AS met").selectExpr(
        "*", "least(shelf, met) AS p", "greatest(shelf, met) AS q").drop("shelf", "met")
    # A row for each label.
    before = checkpointed(shelved.selectExpr("label", "int(sum(shelves * (shelves - 1) / 2) OVER (ORDER BY k DESC, label) - shelves * (shelves - 1) / 2) AS first",
                                             "int(shelves * (shelves - 1) / 2) AS pairs"))
    total = before.agg(F.sum("pairs")).first()[0] or 1
    return sent.join(F.broadcast(before.drop("pairs")), "label").repartitionById(total, F.expr("first + int(q * (q - 1) / 2) + p")).drop("first")


def edges(texts: DataFrame, threshold: float = D.NEAR_DUPLICATE_SIMILARITY, max_chars: int | None = None) -> DataFrame:
    """Verified edges (label, a, b, cosine) that connect exactly the texts connected by all matching pairs.

    Tiles stand on shelves. Each pair of shelves is one group, which also takes
    one of them with itself, so a tile is sent once a shelf, not once a tile.
    Every pair of a label's texts is decided where their tiles meet, unless
    both are known to be in one component. Of two tiles' links only those
    are kept that join components, at most one less than they have texts.
    """
    made = tiles(texts, threshold, max_chars)
    sent = meetings(made)
    with rows_a_batch(texts.sparkSession, 1):
        outer = checkpointed(sent.mapInArrow(_outer(threshold), "label string, links array<struct<a: bigint, b: bigint, cosine: double>>"))
    return made.select("label", "links").unionByName(outer).selectExpr("label", "inline(links)")


def groups(texts: DataFrame, threshold: float = D.NEAR_DUPLICATE_SIMILARITY, max_chars: int | None = None) -> DataFrame:
    """(doc, label, group): the group is the smallest text of the component; a text without a match is its own group."""
    roots = components(edges(texts, threshold, max_chars).select("a", "b"))
    return texts.select("doc", "label").join(roots.withColumnRenamed("node", "doc"), "doc", "left").selectExpr(
        "doc", "label", "coalesce(root, doc) AS `group`")
