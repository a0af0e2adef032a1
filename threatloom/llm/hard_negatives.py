"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Vectors become whole numbers, floor(``scale`` x component), and a score is their
integer inner product with an anchor. Two kinds of windows have to be filled with
the ``k`` highest scores: an anchor's rows of its own label (its positives), and
for each of these, rows of other labels whose score is at most the positive's and
at least a share of it (its negatives).

Rows are packed into segments of ``SEGMENT`` rows where they lie, without a
shuffle. A pass is a threshold join of all segments with a block of anchors: find
every row whose score with an anchor is at least the anchor's threshold.

* Dimensions are ordered by their weight in the data. A segment's inverted index
  has, for each group of dimensions, the rows that need it: a row's last
  dimensions are omitted as soon as the norm of that suffix times the longest
  anchor stays below the lowest threshold.
* Scores are accumulated group by group down the posting lists; after each, rows
  leave whose partial score plus the product of remaining norms reaches no
  anchor's threshold.
* What is left is decided on whole numbers. A segment sends at most ``k`` rows a
  window, and those of all segments are ranked by window.

Thresholds start where a sample lets expect a few times ``k`` rows, and are
lowered for the windows that did not fill, at last to the window's own bottom. A
window that fills holds its highest scores whatever the sample was, so the sample
decides about time alone, not about results.

Anchors are taken in blocks of about ``ANCHOR_BYTES``, which are broadcast; work
is anchors x rows at worst. The sample has at most 2 x ``SAMPLE`` rows.

Defined results: rows with a null id, a null label, a null vector or a null or
non-finite component take no part (nor do finite ones that overflow a double when
scaled); vectors of different lengths do not meet, and empty ones have the score
0; rows repeated under one id are rows of their own, but never positives of an
anchor of that id, and repeated anchors repeat their results; an anchor without
positives, or a positive without negatives, gives no rows; ties go to the smaller
id; scores beyond the range of a long are cut to it; an empty table gives no
rows; other columns are ignored.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .catalogue import query
from .common import BROADCAST_ROWS, checkpointed, read
from .embedding_dedup import few_rows_a_batch

SCALE, POSITIVES, NEGATIVES, LEAST = 256, 5, 5, (80, 100)
SEGMENT, ANCHOR_BYTES, SAMPLE = 4096, 16 << 20, 2048
#: Dimensions of one group of the index, anchors that go through a segment together.
GROUP, TOGETHER = 8, 256
#: Rows that a window's first threshold is to find, as a multiple of those it needs; and how many times as many the next one.
EXPECTED, MORE = 4, 16
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Whole numbers below this are exact as doubles.
EXACT = 2.0 ** 52


def matrices(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each vector length the usable rows of a batch and their vectors in whole numbers."""
    column = batch.column("embedding")
    lengths = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * flat)
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    good = (lengths >= 0) & (np.bincount(owner, ~np.isfinite(flat), minlength=len(lengths)) == 0)
    for c in ("vec_id", "label"):
        good &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == d))
        taken = np.zeros(len(lengths), bool)
        taken[rows] = True
        yield rows, flat[taken[owner]].reshape(len(rows), d)


def _packed(scale: int):
    """Segments (d, n, ids, labels, vectors) of the rows of a partition."""
    def pack(d, ids, labels, vectors):
        ids, labels, vectors = (np.concatenate(x) for x in (ids, labels, vectors))
        small = vectors.astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
            ids, labels, small if (small == vectors).all() else vectors))], ["d", "n", "ids", "labels", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            ids, labels = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            for rows, vectors in matrices(batch, scale):
                for a in range(0, len(rows), SEGMENT):
                    some, d = rows[a:a + SEGMENT], vectors.shape[1]
                    parts = held.setdefault(d, ([], [], []))
                    for kept, x in zip(parts, (ids[some], labels[some], vectors[a:a + SEGMENT])):
                        kept.append(x)
                    if sum(map(len, parts[0])) >= SEGMENT:
                        yield pack(d, *held.pop(d))
        for d, parts in held.items():
            yield pack(d, *parts)
    return run


def unpack(d: int, n: int, ids, labels, vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.float32 if len(vectors) == 4 * n * d else np.float64
    return np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vectors, kind).reshape(n, d).astype(np.float64)


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norms of what remains of each row from each group of dimensions on; the last column is 0."""
    edges = range(0, x.shape[1], GROUP)
    squares = np.stack([(x[:, e:e + GROUP] ** 2).sum(axis=1) for e in edges], axis=1) if x.shape[1] else np.zeros((len(x), 0))
    return np.sqrt(np.c_[np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros(len(x))])


@dataclass
class Anchors:
    """Anchors of one vector length, and the windows that are open, ordered by anchor."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: Of each window: its number, anchor, whether it wants the anchor's label, threshold, highest score, and whether the threshold is its bottom.
    number: np.ndarray
    anchor: np.ndarray
    same: np.ndarray
    low: np.ndarray
    high: np.ndarray
    last: np.ndarray


def whole_scores(y: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of paired rows of whole numbers, exact at any size, cut to the range of a long."""
    if len(y) == 0 or np.sqrt((y ** 2).sum(axis=1).max() * (a ** 2).sum(axis=1).max()) < EXACT:
        return np.einsum("ij,ij->i", y, a).astype(np.int64)
    exact = [sum(int(p) * int(q) for p, q in zip(u, v)) for u, v in zip(y.tolist(), a.tolist())]
    return np.array([max(LOWEST, min(HIGHEST, s)) for s in exact], dtype=np.int64)


def threshold_join(y: np.ndarray, rest_y: np.ndarray, a: np.ndarray, rest_a: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs of rows of y and a with a score of at least the anchor's ``low``; dimensions are in one order."""
    groups, longest = rest_y.shape[1] - 1, rest_a[:, 0].max()
    # Whole numbers leave half a unit for rounding; beyond doubles it is a share of the norms.
    slack = 0.5 if rest_y[:, 0].max() * longest < EXACT else 1e-9 * rest_y[:, 0].max() * longest
    wanted = low.astype(np.float64) - slack
    # A row's postings end where the rest can't reach the lowest threshold any more.
    indexed = (rest_y[:, :-1] * longest >= wanted.min()).sum(axis=1)
    partial, live = np.zeros((len(y), len(a))), np.flatnonzero(indexed > 0)
    alive = np.zeros(len(y), bool)
    alive[live] = True
    alive |= wanted.min() <= 0
    for g in range(groups):
        live = live[indexed[live] > g]
        if not len(live):
            break
        at = slice(g * GROUP, (g + 1) * GROUP)
        grown = partial[live] + y[live, at] @ a[:, at].T
        partial[live] = grown
        stay = (grown + rest_y[live, g + 1, None] * rest_a[None, :, g + 1] >= wanted).any(axis=1)
        alive[live[~stay]] = False
        live = live[stay]
    kept = np.flatnonzero(alive)
    rows, anchors = np.nonzero(partial[kept] + rest_y[kept, indexed[kept], None] * rest_a.T[indexed[kept]] >= wanted)
    rows, scores = kept[rows], []
    for k in range(0, len(rows), 1 << 16):
        scores.append(whole_scores(y[rows[k:k + (1 << 16)]], a[anchors[k:k + (1 << 16)]]))
    scores = np.concatenate(scores) if scores else np.zeros(0, np.int64)
    ok = scores >= low[anchors]
    return rows[ok], anchors[ok], scores[ok]


def best_of_windows(rows, anchors, scores, ids, labels, block: Anchors, k: int):
    """The k highest rows of each window among found pairs: (window, score, id), windows as places in the block's arrays."""
    first = np.searchsorted(block.anchor, anchors)
    count = np.searchsorted(block.anchor, anchors, "right") - first
    pair = np.repeat(np.arange(len(rows)), count)
    window = first[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    same = (labels[rows] == block.labels[anchors])[pair]
    other = (ids[rows] != block.ids[anchors])[pair]
    s = scores[pair]
    ok = np.where(block.same[window], same & other, ~same) & (s >= block.low[window]) & (s <= block.high[window])
    window, s, i = window[ok], s[ok], ids[rows][pair[ok]]
    order = np.lexsort((i, -s.astype(object) if len(s) and s.min() == LOWEST else -s, window))
    window, s, i = window[order], s[order], i[order]
    place = np.arange(len(window)) - np.searchsorted(window, window)
    return window[place < k], s[place < k], i[place < k]


def _searched(shared, order: dict, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = shared.value.get(row["d"])
                if block is None or not len(block.number):
                    continue
                ids, labels, y = unpack(**row)
                y, a = y[:, order[row["d"]]], block.vectors[:, order[row["d"]]]
                rest_y, rest_a = suffix_norms(y), suffix_norms(a)
                searched, first = np.unique(block.anchor, return_index=True)
                low, out = np.minimum.reduceat(block.low, first), []
                for c in range(0, len(searched), TOGETHER):
                    some = searched[c:c + TOGETHER]
                    rows, anchors, scores = threshold_join(y, rest_y, a[some], rest_a[some], low[c:c + TOGETHER])
                    out.append(best_of_windows(rows, some[anchors], scores, ids, labels, block, k))
                window, s, i = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(block.number[window]), pa.array(block.last[window]), pa.array(s), pa.array(i)],
                                                 ["w", "last", "score", "vec_id"])
    return run


@dataclass
class Sample:
    """Rows from which thresholds start, by vector length, and the number of all rows."""

    rows: dict
    total: int

    def thresholds(self, d: int, block: Anchors, wanted: float, bottom: np.ndarray) -> np.ndarray:
        """For each window the score that about ``wanted`` of all rows reach, but at least its bottom."""
        ids, labels, vectors = self.rows.get(d, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, d))))
        place = int(np.ceil(wanted * len(ids) / max(self.total, 1)))
        out = bottom.copy()
        if not place or place > len(ids):
            return out
        for c in range(0, len(out), TOGETHER):
            w = slice(c, c + TOGETHER)
            at = block.anchor[w]
            scores = np.clip(block.vectors[at] @ vectors.T, -EXACT, EXACT)
            same = labels[None, :] == block.labels[at, None]
            fits = np.where(block.same[w, None], same & (ids[None, :] != block.ids[at, None]), ~same) & (scores <= block.high[w, None])
            top = -np.partition(np.where(fits, -scores, np.inf), place - 1, axis=1)[:, place - 1]
            enough = np.isfinite(top)
            out[w] = np.maximum(out[w], np.where(enough, np.where(enough, top, 0).astype(np.int64), out[w]))
        return out


def fill(segments: DataFrame, blocks: dict, bottoms: dict, sample: Sample, order: dict, k: int) -> DataFrame:
    """(w, rank, score, vec_id): the k highest rows of every window, lowering thresholds until they are full."""
    spark, done, wanted = segments.sparkSession, None, EXPECTED * k
    while any(len(b.number) for b in blocks.values()):
        for d, b in blocks.items():
            b.low = sample.thresholds(d, b, wanted, bottoms[d])
            b.last = b.low <= bottoms[d]
        shared = spark.sparkContext.broadcast(blocks)
        with few_rows_a_batch(spark, 4):
            found = segments.mapInArrow(_searched(shared, order, k), "w bigint, last boolean, score bigint, vec_id bigint")
            ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("w").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
            ranked = checkpointed(ranked)
        full = ranked.groupBy("w", "last").agg(F.count("*").alias("n")).where(F.col("last") | (F.col("n") == k)).select("w")
        full = checkpointed(full)
        rows = ranked.join(full, "w").select("w", "rank", "score", "vec_id")
        done = rows if done is None else done.unionByName(rows)
        closed = np.sort(full.toPandas()["w"].to_numpy(dtype=np.int64))  # one number a window of the block
        shared.unpersist()
        for d, b in blocks.items():
            stay = ~b.last & ~np.isin(b.number, closed)
            bottoms[d] = bottoms[d][stay]
            blocks[d] = Anchors(b.ids, b.labels, b.vectors, *(x[stay] for x in (b.number, b.anchor, b.same, b.low, b.high, b.last)))
        wanted *= MORE
    return done


def windows(ids, labels, vectors, number, anchor, same, high) -> Anchors:
    n = len(number)
    return Anchors(ids, labels, vectors, number, anchor, np.full(n, same), np.zeros(n, np.int64), high, np.zeros(n, bool))


def block_rows(anchors: DataFrame, scale: int) -> tuple[dict, dict]:
    """A block's anchors by vector length: (ids, labels, vectors), and how often each is repeated."""
    table, out, copies = anchors.toArrow(), {}, {}
    for batch in table.combine_chunks().to_batches():
        many = batch.column("copies").to_numpy()
        for rows, vectors in matrices(batch, scale):
            new = (batch.column("vec_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64), batch.column("label").to_numpy(zero_copy_only=False)[rows].astype(np.int64), vectors)
            d = vectors.shape[1]
            out[d] = tuple(np.concatenate(x) for x in zip(out[d], new)) if d in out else new
            copies[d] = np.concatenate((copies.get(d, np.zeros(0, np.int64)), many[rows]))
    return out, copies


def mine(vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: tuple[int, int] = LEAST, anchor_bytes: int = ANCHOR_BYTES, sample_rows: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors(vec_id, embedding, label)."""
    spark, (p, q) = vectors.sparkSession, least
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding")
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    segments = checkpointed(rows.mapInArrow(_packed(scale), "d int, n int, ids binary, labels binary, vectors binary"))
    total = segments.agg(F.sum("n")).head()[0]
    if not total:
        return spark.createDataFrame([], schema)
    parts = 1 << 30
    few = rows.where(F.pmod(F.xxhash64("vec_id", "label", F.lit(11)), F.lit(parts)) < int(parts * min(1.0, sample_rows / total))).limit(2 * sample_rows)
    sample = Sample(block_rows(few.withColumn("copies", F.lit(1).cast("bigint")), scale)[0], total)
    chosen = checkpointed(rows.where(is_anchor).groupBy("vec_id", "label", "embedding").agg(F.count("*").alias("copies")))
    size = chosen.agg(F.sum(F.size("embedding") * 8 + 64)).head()[0] or 0
    n_blocks = -(-size // anchor_bytes)
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/hard-negatives-{uuid.uuid4().hex}"
    for number in range(n_blocks):
        own = chosen.where(F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(n_blocks)) == number)
        out = mine_block(segments, sample, *block_rows(own, scale), positives, negatives, p, q)
        (spark.createDataFrame([], schema) if out is None else out).write.mode("overwrite").parquet(f"{folder}/{number}")
    return spark.read.schema(schema).parquet(*[f"{folder}/{b}" for b in range(n_blocks)]) if n_blocks else spark.createDataFrame([], schema)


def mine_block(segments: DataFrame, sample: Sample, anchors: dict, copies: dict, positives: int, negatives: int, p: int, q: int) -> DataFrame | None:
    """Hard negatives of one block of anchors."""
    spark, order, blocks, bottoms, start = segments.sparkSession, {}, {}, {}, {}
    if not anchors:
        return None
    for d, (ids, labels, vectors) in anchors.items():
        weighed = sample.rows.get(d, anchors[d])[2]
        order[d] = np.argsort(-(weighed ** 2).sum(axis=0), kind="stable")
        start[d] = sum(len(anchors[e][0]) for e in start)
        number = np.arange(len(ids)) + start[d]
        blocks[d] = windows(ids, labels, vectors, number, np.arange(len(ids)), True, np.full(len(ids), HIGHEST))
        bottoms[d] = np.full(len(ids), LOWEST)
    found = fill(segments, blocks, bottoms, sample, order, positives)
    near = found.toPandas().sort_values(["w", "rank"])  # at most ``positives`` rows an anchor of the block
    blocks, bottoms, rows, upto = {}, {}, [], 0
    for d, (ids, labels, vectors) in anchors.items():
        mine_ = near[(near["w"] >= start[d]) & (near["w"] < start[d] + len(ids)) & (near["score"] >= 0)]  # below 0 the window is empty
        anchor, score = mine_["w"].to_numpy(dtype=np.int64) - start[d], mine_["score"].to_numpy(dtype=np.int64)
        pairs, window = np.unique(np.c_[anchor, score], axis=0, return_inverse=True)  # positives with one score share a window
        number = np.arange(len(pairs)) + upto
        blocks[d] = windows(ids, labels, vectors, number, pairs[:, 0], False, pairs[:, 1])
        bottoms[d] = np.array([-(-int(s) * p // q) for s in pairs[:, 1]], dtype=np.int64)
        rows.append(pd.DataFrame({"w": number[window.ravel()], "anchor_id": ids[anchor], "positive_id": mine_["vec_id"].to_numpy(dtype=np.int64),
                                  "positive_score": score, "copies": copies[d][anchor]}))
        upto += len(pairs)
    pairs = pd.concat(rows, ignore_index=True)
    hard = fill(segments, blocks, bottoms, sample, order, negatives)
    if hard is None:
        return None
    named = spark.createDataFrame(pairs, "w bigint, anchor_id bigint, positive_id bigint, positive_score bigint, copies bigint")
    named = F.broadcast(named) if len(pairs) <= BROADCAST_ROWS else named
    out = hard.join(named, "w").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
                      F.col("score").alias("negative_score"))


SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
  FROM e a JOIN e b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, s.b AS n, p.s AS ps, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s)
SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5
"""


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding."""
    rows = read(spark, sf_dir, "embeddings")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END")
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)
