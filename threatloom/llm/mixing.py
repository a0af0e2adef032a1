"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. Per source, words are summed by leading hash bits;
the bucket in which the budget ends is the boundary, and only its documents are
summed again by further bits, then by the whole hash. The result is one cut per
source: documents below it are taken once more than those above. Nothing is
sorted, and a source that holds a third of all rows is pre-aggregated in every
map task, never gathered.

Defined results: null text has size 0; null sources form a source of their
own, the last; null ids are hashed by their text; rows with equal hash (repeated
rows) share their fate; an empty table gives no rows; other columns are ignored.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalogue import query
from .common import attach, checkpointed, read, space_words

#: Bits of the 60-bit hash used at each level; the last level has what is left.
LEVELS = (12, 12, 36)


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, copies: int = 2) -> DataFrame:
    """Add ``target`` to (source, source_size): the budget by weight, with every target at most ``copies`` sizes.

    Filling by weight until no target is above its limit ends with one common
    level: sources ordered by limit per weight are full from the front as long
    as their limit per weight is not above what the rest would get. The window
    holds one row a source.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                         ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", cycle).withColumn("limit", F.col("source_size") * F.lit(copies))
    by_limit = W.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    filled = (ranked.withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
              .withColumn("before", F.coalesce(F.sum("limit").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("weights_on", F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)))
              .withColumn("full", F.col("limit") / F.col("weight") <= (F.col("budget") - F.col("before")) / F.col("weights_on"))
              .withColumn("full_sum", F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0)))
              .withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)))
    level = (F.col("budget") - F.col("full_sum")) / F.col("open_weight") * F.col("weight")
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level).alias("target"))


def hashed(docs: DataFrame) -> DataFrame:
    """Add size, source key and hash to docs(doc_id, text, source)."""
    name = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.coalesce("text", F.lit("")))))
    return docs.withColumns({"size": space_words(F.col("text")), "sk": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
                             "key": F.conv(F.substring(name, 1, 15), 16, 10).cast("bigint")})


def cuts(sized: DataFrame, weights, share: float, copies: int, levels) -> tuple[DataFrame, int]:
    """(sk, source_size, target, base, cut) of every source, and their number: rows below the cut are taken base + 1 times, others base times."""
    sources = checkpointed(sized.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")))
    rows = sources.count()
    plan = targets(sources.drop("sk"), weights, share, copies)
    base = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(copies))
    plan = checkpointed(plan.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("sk"), "source_size", "target", base.alias("base"))
        .withColumn("need", F.col("target") - F.col("base") * F.col("source_size")))

    # One level after another: `low` is the first hash of the boundary bucket, `got` the words below it.
    left = sum(levels)
    edge = plan.where("need > 0").select("sk", "need", F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("got"))
    for bits in levels:
        span, left = left, left - bits
        inside = attach(sized.select("sk", "key", "size"), edge, "sk", ["key"], rows).where(
            (F.col("key") >= F.col("low")) & (F.col("key") - F.col("low") < F.lit(1 << span)))
        sums = inside.groupBy("sk", F.shiftrightunsigned("key", left).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("need").alias("need"), F.first("got").alias("got"))
        run = F.sum("words").over(W.partitionBy("sk").orderBy("bucket"))
        edge = checkpointed(sums.withColumn("upto", F.col("got") + run).where("upto >= need").groupBy("sk").agg(
            F.first("need").alias("need"), F.min_by(F.struct("bucket", "upto", "words"), "bucket").alias("b"))
            .select("sk", "need", F.shiftleft("b.bucket", left).alias("low"), (F.col("b.upto") - F.col("b.words")).alias("got"),
                    F.col("b.words").alias("words")))
    # The boundary rows go in when that leaves the total nearer to the target.
    cut = edge.select("sk", F.when((F.col("need") - F.col("got")) * 2 >= F.col("words"), F.col("low") + 1).otherwise(F.col("low")).alias("cut"))
    return checkpointed(plan.join(cut, "sk", "left").select("sk", "source_size", "target", "base", F.coalesce("cut", F.lit(0)).alias("cut"))), rows


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, copies: int = 2, levels=LEVELS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs(doc_id, text, source).

    ``taken`` is 0, 1 or more times the size. A source's taken words end within
    half of its boundary rows' size of its target.
    """
    sized = checkpointed(hashed(docs.select("doc_id", "text", "source")).drop("text"))
    full, rows = cuts(sized, weights, share, copies, levels)
    return attach(sized, full, "sk", ["key"], rows).select(
        "doc_id", "source", "size", "source_size", "target", F.expr("CAST(size * (base + CAST(key < cut AS INT)) AS BIGINT)").alias("taken"))


def mixed_rows(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, copies: int = 2, levels=LEVELS) -> DataFrame:
    """The rows that the mix takes, with all columns of docs, each as many times as it is taken."""
    full, rows = cuts(checkpointed(hashed(docs.select("doc_id", "text", "source")).drop("text")), weights, share, copies, levels)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = hashed(docs.select("doc_id", "text", "source", whole)).drop("doc_id", "text", "source", "size")
    taken = attach(named, full, "sk", ["key"], rows).withColumn("times", F.expr("CAST(base + CAST(key < cut AS INT) AS INT)")).where("times > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 't' || coalesce(text, ''))), 1, 15) AS BIGINT) AS k
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM src),
walked AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget,
    CAST(coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS won
  FROM weighed),
filled AS (SELECT *, 2 * source_size / w <= (budget - before) / won AS isfull FROM walked),
aimed AS (
  SELECT source, source_size, CASE WHEN isfull THEN CAST(2 * source_size AS DOUBLE)
    ELSE (budget - coalesce(CAST(sum(CASE WHEN isfull THEN 2 * source_size END) OVER () AS BIGINT), 0))
         / sum(CASE WHEN NOT isfull THEN w END) OVER () * w END AS target
  FROM filled),
based AS (SELECT *, least(floor(target / greatest(source_size, 1)), 2) AS base FROM aimed),
grouped AS (SELECT source, k, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, k),
running AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY source ORDER BY k) AS BIGINT) AS upto FROM grouped)
SELECT d.doc_id, d.size, b.source_size, b.target,
  CAST(d.size * (b.base + CASE WHEN b.target - b.base * b.source_size > 0 AND (
       r.upto < b.target - b.base * b.source_size
       OR (r.upto - r.words < b.target - b.base * b.source_size AND (b.target - b.base * b.source_size - (r.upto - r.words)) * 2 >= r.words))
     THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN based b ON d.source IS NOT DISTINCT FROM b.source
JOIN running r ON r.k = d.k AND r.source IS NOT DISTINCT FROM d.source
"""


@query("op3_mix_sources", SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
