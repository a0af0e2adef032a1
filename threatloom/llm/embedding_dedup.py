"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are turned into the axes of their second moments, largest first, so
that a few leading coordinates carry most of every product. Rows are ordered by
the first axis and cut into tiles. Tiles whose ranges on that axis lie further
apart than similar unit vectors can are never compared. For the others, leading
coordinates are multiplied first; what is left of a pair's product is at most
the product of the two suffix norms, so pairs whose sum cannot reach the
threshold stop there. The rest gets its whole product in double precision. The
bound of a block is one matrix product, with the suffix norm as one more
coordinate.

Every pair of rows is decided exactly; the work is that of all tile pairs in
range, one task each, with two tiles in memory. A tile holds about ``TILE`` rows
(tiles of one crowded value are cut by hash). Of the links of a tile pair only
counts and a spanning forest leave the task, so a group of copies yields as many
rows as vectors, not as pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths do not link; a null
id takes part, and its component is the smallest known id, or null; rows repeated
under one id are rows of their own and link; an empty table gives no rows; other
columns are ignored.
"""

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .catalogue import query
from .common import BROADCAST_ROWS, checkpointed, read

SIMILARITY, TILE, BLOCK = 0.95, 4096, 1024
#: Leading coordinates of the first product.
LEAD = 16
#: More than rounding can take from a bound in single precision.
SLACK = 1e-4
ROW_BITS = 24


def usable(batch: pa.RecordBatch) -> tuple[np.ndarray, list]:
    """Which rows hold a usable vector, and these vectors."""
    ok, vectors = np.zeros(batch.num_rows, bool), []
    for i, v in enumerate(batch.column("embedding").to_pylist()):
        if v and None not in v:
            x = np.array(v, dtype=np.float64)
            n = np.linalg.norm(x)
            if np.isfinite(n) and n > 0:
                ok[i] = True
                vectors.append(x)
    return ok, vectors


def _moments(batches):
    sums: dict = {}
    for batch in batches:
        by_length: dict = {}
        for x in usable(batch)[1]:
            by_length.setdefault(len(x), []).append(x / np.linalg.norm(x))
        for d, rows in by_length.items():
            u = np.array(rows)
            sums[d] = sums.get(d, 0) + u.T @ u
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(m.tolist(), pa.list_(pa.float64()))], ["d", "i", "row"])


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the axes of the second moments of all unit vectors, largest first."""
    parts = vectors.mapInArrow(_moments, "d bigint, i bigint, row array<double>")
    cells = parts.select("d", "i", F.posexplode("row").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    out: dict = {}
    for r in cells.collect():  # length x length numbers
        out.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["v"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for d, m in out.items()}


def _placed(shared):
    def run(batches):
        for batch in batches:
            ok, vectors = usable(batch)
            first, d = np.full(len(ok), np.nan), np.zeros(len(ok), np.int64)
            first[ok] = [x @ shared.value[len(x)][:, 0] / np.linalg.norm(x) for x in vectors]
            d[ok] = [len(x) for x in vectors]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() if k else None for k, x in _spread(ok, vectors)], pa.binary()),
                                              pa.array(d), pa.array(first)], ["vec_id", "raw", "d", "first"])
    return run


def _spread(ok, vectors):
    it = iter(vectors)
    return [(k, next(it) if k else None) for k in ok]


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    first = table.column("first").to_numpy()
    raw = b"".join(table.column("raw").to_pylist())
    return pa.table({"d": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                     "raw": pa.array([raw], pa.binary()), "lo": pa.array([first.min()]), "hi": pa.array([first.max()])})


def tiles(rows: DataFrame) -> DataFrame:
    """(tile, d, ids, raw, lo, hi): rows cut by their place on the first axis, and by hash where one place holds too many."""
    out = None
    n = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}  # one row a vector length
    for d, count in n.items():
        own = rows.where(F.col("d") == d)
        k = -(-count // TILE)
        cuts = sorted(set(own.approxQuantile("first", [i / k for i in range(1, k)], 0.1 / k))) if k > 1 else []
        place = sum([(F.col("first") > c).cast("int") for c in cuts], F.lit(0))
        placed = own.withColumn("place", place)
        crowd = placed.groupBy("place").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
        cut = placed.join(F.broadcast(crowd), "place").withColumn("part", F.pmod(F.xxhash64("vec_id", "raw"), F.col("parts")))
        made = cut.select("d", "place", "part", "vec_id", "raw", "first").groupBy("d", "place", "part").applyInArrow(
            _tile, "d bigint, ids array<bigint>, raw binary, lo double, hi double")
        out = made if out is None else out.unionByName(made)
    return out


class Links:
    """Link counts and a spanning forest of rows numbered 0 to n - 1."""

    def __init__(self, n: int):
        self.count, self.edges = np.zeros(n, np.int64), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count += np.bincount(np.concatenate((a, b)), minlength=len(self.count))
        self.edges.append(self.forest(a, b))

    def forest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row with the smallest row of its component."""
        label = np.arange(len(self.count))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        nodes = np.flatnonzero(label != np.arange(len(label)))
        return nodes, label[nodes]

    def all_edges(self):
        if not self.edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.forest(*(np.concatenate(x) for x in zip(*self.edges)))


def compare(x: np.ndarray, y: np.ndarray, same: bool, similarity: float) -> Links:
    """Links between rows of two matrices of turned unit vectors; rows of y count after those of x, or are those of x."""
    links = Links(len(x) if same else len(x) + len(y))
    lead = min(LEAD, x.shape[1])
    short = lambda m: np.c_[m[:, :lead], np.sqrt(np.maximum(0, (m[:, lead:] ** 2).sum(axis=1)))].astype(np.float32)
    sx, sy = short(x), short(y)
    for i in range(0, len(x), BLOCK):
        for j in range(i if same else 0, len(y), BLOCK):
            a, b = np.nonzero(sx[i:i + BLOCK] @ sy[j:j + BLOCK].T >= similarity - SLACK)
            if same and i == j:
                a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            if len(a) * 8 > BLOCK * BLOCK:  # many: one product in double precision
                ok = (x[i:i + BLOCK] @ y[j:j + BLOCK].T)[a, b] >= similarity
            else:
                ok = np.concatenate([np.einsum("ij,ij->i", x[a[k:k + 65536] + i], y[b[k:k + 65536] + j]) for k in range(0, len(a), 65536)]) >= similarity
            if ok.any():
                links.add(a[ok] + i, b[ok] + j + (0 if same else len(x)))
    return links


def _compared(shared, similarity):
    def matrix(raw, d):
        m = np.frombuffer(raw, dtype=np.float64).reshape(-1, d)
        return (m / np.linalg.norm(m, axis=1)[:, None]) @ shared.value[d]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, d = (batch.column(c)[i].as_py() for c in ("a", "b", "d"))
                x = matrix(batch.column("raw_a")[i].as_buffer(), d)
                y = x if a == b else matrix(batch.column("raw_b")[i].as_buffer(), d)
                links = compare(x, y, a == b, similarity)
                key = (np.int64(a) << ROW_BITS) + np.arange(len(x))
                if a != b:
                    key = np.concatenate((key, (np.int64(b) << ROW_BITS) + np.arange(len(y))))
                some, (u, v) = np.flatnonzero(links.count), links.all_edges()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((key[some], key[u]))), pa.array([None] * len(some) + key[v].tolist(), pa.int64()),
                    pa.array(np.concatenate((links.count[some], np.zeros(len(u), np.int64))))], ["u", "v", "n"])
    return run


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 8):
    """Rows that hold two tiles go to Python a few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def deduplicate(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    shared = spark.sparkContext.broadcast(axes(vectors))
    rows = checkpointed(vectors.mapInArrow(_placed(shared), "vec_id bigint, raw binary, d bigint, first double"))
    lone = rows.where("d = 0").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    made = tiles(rows.where("d > 0"))
    if made is None:
        return lone
    made = checkpointed(made.withColumn("tile", F.monotonically_increasing_id()))
    names = {r["tile"]: i for i, r in enumerate(made.select("tile").collect())}  # one number a tile
    number = spark.createDataFrame(list(names.items()), "tile bigint, t bigint")
    hint = F.broadcast if len(names) <= BROADCAST_ROWS else (lambda df: df)
    made = checkpointed(made.join(hint(number), "tile").drop("tile"))
    far = float(np.sqrt(max(0.0, 2 - 2 * similarity)) + SLACK)
    a, b = (made.select(F.col("d").alias(f"d_{s}"), F.col("t").alias(s), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")) for s in "ab")
    pairs = a.join(hint(b), (F.col("d_a") == F.col("d_b")) & (F.col("a") <= F.col("b")) & (F.col("lo_b") - F.col("hi_a") <= far)
                   & (F.col("lo_a") - F.col("hi_b") <= far)).select("a", "b")
    both = (checkpointed(pairs).join(made.select(F.col("t").alias("a"), "d", F.col("raw").alias("raw_a")), "a")
            .join(made.select(F.col("t").alias("b"), F.col("raw").alias("raw_b")), "b"))
    with few_rows_a_batch(spark):
        found = checkpointed(both.mapInArrow(_compared(shared, similarity), "u bigint, v bigint, n bigint"))
    counts = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n_links"))
    roots = components(found.where("v IS NOT NULL").selectExpr("u AS a", "v AS b"))
    named = made.select("t", F.posexplode("ids").alias("i", "vec_id")).select((F.shiftleft("t", ROW_BITS) + F.col("i")).alias("u"), "vec_id")
    linked = checkpointed(named.join(counts, "u", "left").join(roots.withColumnRenamed("node", "u"), "u", "left"))
    tops = linked.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("top"))
    out = linked.join(tops, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("top", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).unionByName(lone)


SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT a AS v, a AS u FROM l UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.u),
c AS (SELECT v, min(u) AS c FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.c, vec_id) AS component_id, vec_id = coalesce(c.c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.v = vec_id
"""


@query("op9_embedding_dedup", SQL)
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return deduplicate(read(spark, sf_dir, "embeddings"))
