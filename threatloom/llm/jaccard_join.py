"""N-gram Jaccard join by vertical partitioning, as components of linked texts.

Shingles have one global order, that of their hashes, and every set is sorted by
it. Steps:

1. Texts with equal shingle sets are one class (fingerprint of the set).
2. A set that links with another shares enough of its leading shingles with it
   (prefix of an overlap bound). Leading shingles are exchanged once by hash; sets
   with too few shared ones can have no link and leave. Within a chunk of
   documents shared shingles are found before the exchange, so that a shingle of
   a third of all texts arrives as one row a chunk.
3. Remaining sets link to the smallest set that has the same first shingles, if
   similar enough. That joins most near copies with one pair a set, not with all
   pairs of a group.
4. Sets of different components that share a leading shingle form families. The
   order here has frequent shingles at the end, so that a widespread passage
   brings nothing together. A family is cut into tiles, and tiles of fitting sizes
   are compared, unless both are of one component: no link between components is
   lost, and what leaves a task is a spanning forest, not pairs. Tiles are first
   compared by parity bitmaps, some three bits a shingle: two bitmaps differ in at
   most as many bits as their sets in shingles, so a pair whose bitmaps differ in
   more than a link allows is none. Only sets with a pair left are sent whole.

Overlaps are counted by fragments: the global order is cut into ranges, the
overlap of a pair is counted in each apart, and summed by pair; by joins for the
pairs of step 3, and for all pairs of two tiles at once in step 4.

Similarity is exact: q * overlap >= p * union for a threshold p/q. Sets are
identified by 64-bit hashes of shingles and sets.

Defined results: texts without words, or null, have no shingles, link with
nothing and are their own component; equal texts link; a null id takes part, and
its component is the smallest known id, or null; repeated rows repeat their
result; an empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import components
from .catalogue import query
from .common import BROADCAST_IDS, byte_texts, checkpointed, membership, pieces, read
from .embedding_dedup import Links
from .words import FOLD_SPACE, mixed, shingles

SHINGLE, SIMILARITY = 5, (75, 100)
FRAGMENT_BITS = 3
FRAGMENTS = 1 << FRAGMENT_BITS
#: Part of a set that its prefix is longer than one common shingle needs; step 2 then asks for as much in common.
EXTRA = 0.08
#: First shingles by which step 3 pairs sets.
FIRST = 3
#: A shingle of so many sets, or more, comes late in the order of step 4.
FREQUENT = 16
#: Most sets and shingles of a tile of step 4, about.
TILE, TILE_SHINGLES = 256, 150_000
#: Tiles of a family that are sent together, about.
SHELF = 32
#: Bits of a bitmap for each shingle of its set, at least; rounded up to a power of two.
BITS = 2


def moved(table: DataFrame) -> DataFrame:
    """A table that grows with the input, joined by shuffle: sizes are only estimated, and one that is small in its files may fill the driver."""
    return table.hint("merge")


def least(n, p: int, q: int):
    """Smallest overlap of a set of n with any set that it links with."""
    return -(-n * p // q)


def prefix(n, p: int, q: int):
    return np.minimum(n, n - least(n, p, q) + 1 + np.floor(EXTRA * n).astype(np.int64))


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit number a set."""
    with np.errstate(over="ignore"):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
        ends = np.cumsum(counts)
        return mixed(run[ends] - run[ends - counts] + counts.astype(np.uint64))


def _classes(size):
    def run(batches):
        for batch in pieces(batches):
            hashes, counts = shingles(byte_texts(batch, "text"), FOLD_SPACE, size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(fingerprints(hashes, counts).view(np.int64))],
                                             ["doc_id", "n_shingles", "id"])
    return run


def _leading(size, p, q):
    """(key, id, known): a leading shingle to be compared; or, with known > 0, as many that are shared within the
    chunk; or, with known < 0, a shingle shared within the chunk, for others to meet."""
    def run(batches):
        for batch in pieces(batches):
            hashes, counts = shingles(byte_texts(batch, "text"), FOLD_SPACE, size)
            ids = fingerprints(hashes, counts)
            _, firsts = np.unique(ids, return_index=True)  # copies within the chunk count once
            once = np.isin(np.arange(len(counts)), firsts)
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
            take = np.repeat(once, counts) & (place < np.repeat(prefix(counts, p, q), counts))
            key, owner = hashes[take], np.repeat(np.arange(len(counts)), counts)[take]
            values, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            shared = n[inverse] > 1
            known = np.bincount(owner[shared], minlength=len(counts))
            have = np.flatnonzero(known)
            marks = values[n > 1]
            keys = np.concatenate((key[~shared], mixed(ids[have]), marks)).view(np.int64)
            owners = np.concatenate((ids[owner[~shared]], ids[have], np.zeros(len(marks), np.uint64))).view(np.int64)
            count = np.concatenate((np.zeros((~shared).sum(), np.int64), known[have], np.full(len(marks), -1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners), pa.array(count.astype(np.int64))], ["key", "id", "known"])
    return run


def _sets(size):
    def run(batches):
        for batch in pieces(batches):
            hashes, counts = shingles(byte_texts(batch, "text"), FOLD_SPACE, size)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(hashes, counts).view(np.int64)), pa.array(counts), arrays], ["id", "n", "hashes"])
    return run


def verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Those of pairs(a, b) that are similar enough: overlaps by fragment of the order, summed by pair."""
    cut = [F.expr(f"filter(hashes, h -> shiftrightunsigned(h, {64 - FRAGMENT_BITS}) = {f})") for f in range(FRAGMENTS)]
    segments = sets.select("id", "n", F.posexplode(F.array(*cut)).alias("fragment", "segment")).where(F.size("segment") > 0)
    left = moved(pairs).join(segments.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("segment").alias("s_a")), "a")
    both = moved(left).join(segments.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("segment").alias("s_b")), ["b", "fragment"])
    partial = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("common"))
    return partial.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")).where(
        F.col("common") * (p + q) >= (F.col("n_a") + F.col("n_b")) * p).select("a", "b")


def candidate_sets(docs: DataFrame, classes: DataFrame, size: int, p: int, q: int) -> DataFrame:
    """(id, n, hashes) of the sets that may link with another one."""
    leading = docs.select("text").mapInArrow(_leading(size, p, q), "key bigint, id bigint, known bigint")
    order = W.partitionBy("key").orderBy("id")
    # Of the rows that copies of a set bring for one shingle, at least one stands next to another set's, if there is one.
    near = [F.coalesce(at("id").over(order) != F.col("id"), F.lit(False)) for at in (F.lag, F.lead)]
    met = (near[0] | near[1]).cast("int")
    counts = (leading.select("id", F.when(F.col("known") == 0, met).otherwise(F.col("known")).alias("shared"))
              .where("shared > 0").groupBy("id").agg(F.sum("shared").alias("shared")))
    # The prefix of the smallest partner is the shorter one.
    need = F.lit(1) + F.floor(F.lit(EXTRA) * F.ceil(F.col("n") * p / F.lit(q)))
    maybe = checkpointed(classes.join(moved(counts), "id").where(F.col("shared") >= need).select(F.col("first_doc").alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text")
    rows = membership(texts.where("doc_id IS NOT NULL"), maybe, "left_semi").unionByName(texts.where("doc_id IS NULL"))
    return checkpointed(rows.select("text").mapInArrow(_sets(size), "id bigint, n bigint, hashes array<bigint>").where("n > 0").dropDuplicates(["id"]))


def rare_first(sets: DataFrame) -> DataFrame:
    """Add ``ordered``: the shingles with those that FREQUENT or more sets have at the end, each part by hash.

    A set that shares only a widespread passage then has none of it among its
    leading shingles. Up to BROADCAST_IDS frequent shingles are broadcast; more
    are joined by shuffle.
    """
    each = sets.select("id", F.explode("hashes").alias("h"))
    frequent = checkpointed(each.groupBy("h").count().where(F.col("count") >= FREQUENT).select("h"))
    if frequent.count() > BROADCAST_IDS:
        marked = each.join(moved(frequent.withColumn("late", F.lit(1))), "h", "left").groupBy("id").agg(
            F.array_sort(F.collect_list(F.struct(F.coalesce("late", F.lit(0)).alias("late"), "h"))).alias("x"))
        return moved(sets).join(marked.select("id", F.transform("x", lambda e: e["h"]).alias("ordered")), "id")
    late = sets.sparkSession.sparkContext.broadcast(np.sort(frequent.toArrow().column("h").to_numpy()))

    def reorder(batches):
        for batch in batches:
            hashes = batch.column("hashes")
            flat, ends = hashes.flatten().to_numpy(), np.cumsum(batch.column("n").to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), batch.column("n").to_numpy())
            order = np.lexsort((flat, np.isin(flat, late.value), owner))
            cut = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cut, pa.array(flat[order]))], [*batch.schema.names, "ordered"])
    return sets.mapInArrow(reorder, "id bigint, n bigint, hashes array<bigint>, ordered array<bigint>")


def first_pairs(sets: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): each set with the smallest id that has one of the same first shingles, if their sizes fit."""
    rows = sets.select("id", "n", F.explode(F.slice("hashes", 1, FIRST)).alias("h"))
    first = rows.groupBy("h").agg(F.min(F.struct("id", "n")).alias("c"))
    fits = (F.least("n", "c.n") * q >= F.greatest("n", "c.n") * p) & (F.col("id") != F.col("c.id"))
    return rows.join(moved(first), "h").where(fits).select(F.col("id").alias("a"), F.col("c.id").alias("b")).distinct()


def tiled(sets: DataFrame, parts: DataFrame, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """Tile and component of each set that may still link across components, and the pairs of tiles to compare.

    A family is what hangs together by shared leading shingles of sets of
    different components. It is cut by component (where one fills a tile), by
    size, by a shared shingle, and by id, so that no tile has more than about ``TILE`` sets or
    ``TILE_SHINGLES`` shingles. Returns (id, n, part, tile) and (a, b).
    """
    n = F.col("n")
    lead = F.least(n, n - F.ceil(n * p / F.lit(q)) + 1).cast("int")
    named = (rare_first(sets).select("id", "n", F.slice("ordered", F.lit(1), lead).alias("lead"))
             .join(moved(parts.withColumnRenamed("node", "id")), "id", "left").withColumn("part", F.coalesce("root", "id")))
    rows = named.select("id", "n", "part", F.explode("lead").alias("h"))
    by_shingle = rows.groupBy("h").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.min("id").alias("first")).where("x <> y")
    live = rows.join(moved(by_shingle.select("h", "first")), "h").select("id", "n", "part", "first")
    edges = checkpointed(live.groupBy("id", "first").agg(F.first("n").alias("n"), F.first("part").alias("part")))
    families = components(edges.selectExpr("id AS a", "first AS b"))
    members = edges.groupBy("id").agg(F.first("n").alias("n"), F.first("part").alias("part"), F.min("first").alias("first")).join(
        moved(families.selectExpr("node AS id", "root AS family")), "id")
    full = members.groupBy("family", "part").count().where(F.col("count") >= TILE // 2).select("family", "part", F.col("part").alias("own"))
    cut = members.join(moved(full), ["family", "part"], "left").select(
        "id", "n", "part", "own", "first", F.concat_ws("|", "family", F.coalesce(F.col("own").cast("string"), F.lit("-")), F.floor(
            F.log(n.cast("double")) / F.log(F.lit(q / p)))).alias("tile"))
    # Sets that share a shingle stay together as far as tiles have room; what is still too much is cut by id.
    for near in ("first", "id"):
        crowd = cut.groupBy("tile").agg(F.greatest(F.ceil(F.count("*") / F.lit(TILE)), F.ceil(F.sum("n") / F.lit(TILE_SHINGLES))).alias("salts"))
        cut = checkpointed(cut.join(moved(crowd), "tile").withColumn("tile", F.concat_ws("|", "tile", F.pmod(F.xxhash64(near), F.col("salts")))).drop("salts"))
    placed = cut
    about = placed.groupBy("tile").agg(F.first("own").alias("own"), F.min("n").alias("low"), F.max("n").alias("high"))
    seen = checkpointed(edges.select("id", "first").join(moved(placed.select("id", "tile")), "id").select("first", "tile").distinct().join(moved(about), "tile"))
    x, y = seen.alias("x"), seen.alias("y")
    pairs = x.join(moved(y), (F.col("x.first") == F.col("y.first")) & (F.col("x.tile") <= F.col("y.tile"))
                   & (F.col("x.high") * q >= F.col("y.low") * p) & (F.col("y.high") * q >= F.col("x.low") * p)
                   & ~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False))).select(
        F.col("x.tile").alias("a"), F.col("y.tile").alias("b")).distinct()
    return placed.select("id", "n", "part", "tile"), checkpointed(pairs)


def bitmaps(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of sets, one after another, and the 64-bit words of each.

    Bit j tells whether an odd number of shingles end in j, so the exclusive or of
    two bitmaps is the bitmap of the symmetric difference. The number of words is
    a power of two; a wider bitmap folds to a narrower one by exclusive or.
    """
    words = 1 << np.ceil(np.log2(np.maximum(counts * BITS / 64, 1))).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = hashes & (64 * words[owner] - 1).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, (np.cumsum(words) - words)[owner] + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out, words


def _bitmaps(batches):
    for batch in batches:
        counts = batch.column("n").to_numpy()
        out, words = bitmaps(batch.column("hashes").flatten().to_numpy().view(np.uint64), counts)
        ends = np.concatenate(([0], np.cumsum(8 * words))).astype(np.int32)
        bits = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), bits], ["id", "bits"])


class Sketches:
    """Bitmaps of one tile, with the ids, sizes and components of their sets."""

    def __init__(self, rows: pa.StructArray):
        self.ids, self.sizes, self.parts = (rows.field(c).to_numpy().astype(np.int64) for c in ("id", "n", "part"))
        self.bits = [np.frombuffer(b, np.uint64) for b in rows.field("bits").to_pylist()]
        self.width = min(len(b) for b in self.bits)
        self.folds: dict = {}

    def folded(self, width: int) -> np.ndarray:
        """One row a word of ``width`` words, one column a set."""
        if width not in self.folds:
            self.folds[width] = np.array([np.bitwise_xor.reduce(b.reshape(-1, width), axis=0) for b in self.bits]).T.copy()
        return self.folds[width]


def possible(x: Sketches, y: Sketches, p: int, q: int) -> np.ndarray:
    """Which sets of x may link with which of y, as far as sizes, components and bitmaps tell."""
    width = min(x.width, y.width)
    apart = np.zeros((len(x.ids), len(y.ids)), np.int64)
    for u, v in zip(x.folded(width), y.folded(width)):
        apart += np.bitwise_count(u[:, None] ^ v[None, :])
    n, m = x.sizes[:, None], y.sizes[None, :]
    fits = np.minimum(n, m) * q >= np.maximum(n, m) * p
    return (apart * (p + q) <= (n + m) * (q - p)) & fits & (x.parts[:, None] != y.parts[None, :])


def _possible_shelves(p, q):
    def run(key: tuple, tiles: pa.Table, pairs: pa.Table) -> pa.Table:
        held = {name: Sketches(rows.values) for name, rows in zip(tiles.column("tile").to_pylist(), tiles.column("rows"))}
        out: dict = {"key": [], "a": [], "b": [], "xs": [], "ys": []}
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            x, y = held[a], held[b]
            some = possible(x, y, p, q)
            if some.any():
                for name, value in zip(out, (key[0].as_py(), a, b, x.ids[some.any(axis=1)], y.ids[some.any(axis=0)])):
                    out[name].append(value)
        return pa.table(out, pa.schema([("key", pa.string()), ("a", pa.string()), ("b", pa.string()), ("xs", pa.list_(pa.int64())), ("ys", pa.list_(pa.int64()))]))
    return run


class Tile:
    """Sets of one tile: their ids, sizes, and all shingles with the sets that they are from, sorted by shingle."""

    def __init__(self, ids: pa.Array, hashes: pa.ListArray):
        self.ids = ids.to_numpy()
        self.sizes = pa.compute.list_value_length(hashes).to_numpy().astype(np.int64)
        flat = hashes.flatten().to_numpy().view(np.uint64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(self.ids)), self.sizes)[order]

    def part(self, values: np.ndarray) -> np.ndarray:
        """One row a set, one column a shingle of ``values``: 1 where the set has it."""
        low, high = np.searchsorted(self.flat, values[[0, -1]], "left")[0], np.searchsorted(self.flat, values[-1], "right")
        at = np.searchsorted(values, self.flat[low:high])
        hit = values[at] == self.flat[low:high]
        m = np.zeros((len(self.ids), len(values)), np.float32)
        m[self.owner[low:high][hit], at[hit]] = 1
        return m


def overlaps(x: Tile, y: Tile) -> np.ndarray:
    """Common shingles of every set of x with every set of y: counted by fragment of the order, and summed."""
    total = np.zeros((len(x.ids), len(y.ids)), np.int64)
    both = np.intersect1d(x.flat, y.flat)
    for k in range(0, len(both), 4096):
        part = both[k:k + 4096]
        total += (x.part(part) @ y.part(part).T).astype(np.int64)
    return total


def _linked_shelves(p, q):
    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        held = {}
        for name in sets.column("tile").unique().to_pylist():
            rows = sets.filter(pa.compute.equal(sets.column("tile"), name)).combine_chunks()
            held[name] = Tile(rows.column("id").chunk(0), rows.column("hashes").chunk(0))
        first = dict(zip(held, np.cumsum([0, *(len(t.ids) for t in held.values())]).tolist()))
        every = np.concatenate([t.ids for t in held.values()])
        links = Links(len(every))
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            x, y = held[a], held[b]
            i, j = np.nonzero(overlaps(x, y) * (p + q) >= (x.sizes[:, None] + y.sizes[None, :]) * p)
            if a == b:
                i, j = i[i < j], j[i < j]
            if len(i):
                links.add(i + first[a], j + first[b])
        u, v = links.all_edges()
        return pa.table({"a": pa.array(every[u], pa.int64()), "b": pa.array(every[v], pa.int64())})
    return run


def tile_links(sets: DataFrame, parts: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): links between sets of different components, as a spanning forest of each pair of shelves.

    About ``SHELF`` tiles of a family stand on a shelf. A task gets the bitmaps of
    two shelves and compares the pairs of their tiles, so that a tile is sent once
    a shelf that it meets, not once a tile. Then the sets that have a pair left go
    there whole.
    """
    placed, pairs = tiled(sets, parts, p, q)
    tiles = placed.select("tile", F.substring_index("tile", "|", 1).alias("family")).distinct()
    shelves = checkpointed(tiles.join(moved(tiles.groupBy("family").agg(F.ceil(F.count("*") / F.lit(SHELF)).alias("n"))), "family").select(
        "tile", F.concat_ws("|", "family", F.pmod(F.xxhash64("tile"), F.col("n"))).alias("shelf")))
    of_a, of_b = (shelves.select(F.col("tile").alias(s), F.col("shelf").alias(f"shelf_{s}")) for s in "ab")
    wanted = checkpointed(pairs.join(moved(of_a), "a").join(moved(of_b), "b").select(
        F.concat_ws("#", F.least("shelf_a", "shelf_b"), F.greatest("shelf_a", "shelf_b")).alias("key"), "a", "b"))
    packed = checkpointed(moved(placed).join(sets.select("id", "n", "hashes").mapInArrow(_bitmaps, "id bigint, bits binary"), "id").groupBy("tile").agg(
        F.collect_list(F.struct("id", "n", "part", "bits")).alias("rows")))
    sent = wanted.select("key", F.explode(F.array("a", "b")).alias("tile")).distinct()
    rows = moved(packed).join(sent, "tile").select("key", "tile", "rows")
    left = checkpointed(rows.groupBy("key").cogroup(wanted.withColumnRenamed("key", "meeting").groupBy("meeting")).applyInArrow(
        _possible_shelves(p, q), "key string, a string, b string, xs array<bigint>, ys array<bigint>"))
    sides = [left.select("key", F.col(side).alias("tile"), F.explode(ids).alias("id")) for side, ids in (("a", "xs"), ("b", "ys"))]
    whole = checkpointed(sides[0].unionByName(sides[1]).distinct())
    rows = moved(sets.select("id", "hashes")).join(whole, "id").select("key", "tile", "id", "hashes")
    found = rows.groupBy("key").cogroup(left.select(F.col("key").alias("meeting"), "a", "b").groupBy("meeting")).applyInArrow(_linked_shelves(p, q), "a bigint, b bigint")
    return checkpointed(found)


def linked(docs: DataFrame, similarity=SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    p, q = similarity
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = checkpointed(docs.mapInArrow(_classes(size), "doc_id bigint, n_shingles bigint, id bigint"))
    classes = rows.where("n_shingles > 0").groupBy("id").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("first_doc"))
    sets = candidate_sets(docs, classes, size, p, q)
    near = checkpointed(verified(first_pairs(sets, p, q), sets, p, q))
    parts = components(near)
    far = tile_links(sets, parts, p, q)
    roots = components(near.unionByName(far))
    # A class has the smallest id of its component's classes.
    tops = classes.join(moved(roots.withColumnRenamed("node", "id")), "id").groupBy("root").agg(F.min("first_doc").alias("top"))
    of_class = classes.join(moved(roots.withColumnRenamed("node", "id").join(moved(tops), "root").select("id", "top")), "id", "left").select(
        "id", F.coalesce("top", "first_doc").alias("component_id"))
    some = rows.where("n_shingles > 0").join(moved(of_class), "id", "left").select("doc_id", "n_shingles", "component_id")
    return some.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, similarity=SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Rows of docs whose id is that of their component, with all their columns.

    Rows with a null id stay; of rows repeated under one id, all stay.
    """
    gone = checkpointed(linked(docs, similarity, size).where("doc_id <> component_id").select("doc_id").distinct())
    return membership(docs, gone, "left_anti").select(docs.columns)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 75 * (x.n + y.n - o.o)),
r AS (SELECT a AS v, a AS u FROM l UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u),
c AS (SELECT v, min(u) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = d.doc_id
"""


@query("op7_jaccard_join", SQL)
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicate texts of every document."""
    return linked(read(spark, sf_dir, "documents"))
