"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows fall into a fixed number of logical parts by hash. How many rows each part
sends to each shard is drawn first: every part draws without replacement from
the places still free in the shards, so row and column sums are exact. Then the
rows of a part are permuted and dealt out by these counts, and the rows of a
shard are permuted again, in buckets of the second random key, whose counts
give each bucket its first slot. No task gathers a shard or a hot text: copies
of a text have different ids and fall anywhere.

Law ``rows``: counts of any two shards differ by one at most. The same seed and
rows give the same shards, whatever the physical partitions.

Defined results: null text counts 8 bytes and crc 0; null ids are spread by
their text's checksum; repeated rows are separate rows and get separate slots;
an empty table gives no rows. In ``shard_rows`` an input column named like a
result column is replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalogue import query
from .common import checkpointed, read

PARTS = 4096
#: Buckets of the second permutation in each shard.
BUCKETS = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones in n draws without replacement, for totals of any size.

    Inversion over the probabilities near the mode; what lies further off than
    15 standard deviations is below the resolution of a double.
    """
    lowest, highest = max(0, n - bad), min(good, n)
    if lowest == highest:
        return lowest
    total = good + bad
    mean = n * (good / total)
    sd = (mean * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    a, b = max(lowest, int(mean - 15 * sd) - 1), min(highest, int(mean + 15 * sd) + 1)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log_p = np.concatenate(([0.0], np.cumsum(steps)))
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each part sends to each shard."""
    rng, n = np.random.default_rng(seed), sum(counts)
    free = [n // shards + (s < n % shards) for s in range(shards)]
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for i, rows in enumerate(counts):
        rest, places = rows, sum(free)
        for s in range(shards):
            if not rest:
                break
            places -= free[s]
            x = hypergeometric(rng, free[s], places, rest)
            out[i, s] = x
            free[s] -= x
            rest -= x
    return out


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """Rows with size, text_crc32, part and the two random keys, beside a struct of all their columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    key = lambda k: F.xxhash64("doc_id", "text_crc32", F.lit(seed), F.lit(k))
    return (rows.withColumn("part", F.pmod(key(0), F.lit(PARTS)).cast("int")).withColumn("first_key", key(1))
            .withColumn("second_key", key(2)).withColumn("bucket", F.pmod(F.col("second_key"), F.lit(BUCKETS)).cast("int")))


def dealt(rows: DataFrame, sent: DataFrame) -> DataFrame:
    """Permute the rows of each part and deal them out by the part's counts."""
    place = F.row_number().over(W.partitionBy("part").orderBy("first_key", "doc_id", "text_crc32"))
    return (rows.withColumn("place", place).join(F.broadcast(sent), "part")
            .withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("place")))).drop("place", "upto"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 7, payload: bool = True) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (null: this law has no growth rule).

    ``payload`` False leaves out the columns of docs other than doc_id.
    """
    spark = docs.sparkSession
    rows = keyed(docs, seed)
    slim = checkpointed(rows.drop("row"))
    counts = {r["part"]: r["n"] for r in slim.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most PARTS
    parts = sorted(counts)
    upto = np.cumsum(matrix([counts[p] for p in parts], shards, seed), axis=1)
    # From Arrow: a list of rows would go through Python workers, which then stay beside those of the stages before.
    sent = spark.createDataFrame(pa.table({"part": pa.array(parts, pa.int32()), "upto": pa.array(upto.tolist(), pa.list_(pa.int64()))}))
    # First slot of each bucket; equal keys mean equal buckets, so ties in the deal do not change these counts.
    sizes = dealt(slim, sent).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = sizes.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    own = dealt(rows if payload else slim, sent)
    ranked = own.withColumn("at", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("second_key", "doc_id", "text_crc32")))
    out = ranked.join(F.broadcast(first), ["shard", "bucket"])  # at most shards x BUCKETS rows
    made = {"size": F.col("size"), "text_crc32": F.col("text_crc32"), "law": F.lit("rows"), "shard": F.col("shard").cast("int"),
            "slot": (F.col("first") + F.col("at") - 1).cast("bigint"), "grown_shard": F.lit(None).cast("int")}
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in made] if payload else [F.col("doc_id")]
    return out.select(*kept, *[c.alias(n) for n, c in made.items()])


@query("op5_shard_documents")
def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, 24 shards."""
    return shard_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), payload=False)
