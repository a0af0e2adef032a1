"""Ordered computations over groups that may be far larger than one task.

A plain window puts a whole partition into one task. These helpers cut each
partition into ordered buckets, compute inside the buckets, and carry the
bucket boundaries over a small summary (one row per partition and bucket).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucketed_lag(df: DataFrame, keys: list, bucket: str, order: list, value: str, out: str) -> DataFrame:
    """``out`` = value of the previous row in (keys, order). ``bucket`` must grow with the order."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    rows = df.select("*", F.lag(value).over(inside).alias("_prev"), F.row_number().over(inside).alias("_rn"))
    ends = df.groupBy(*keys, bucket).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    ends = ends.select(*keys, bucket, F.lag("_end").over(Window.partitionBy(*keys).orderBy(bucket)).alias("_before"))
    ends = ends.withColumn("_first", F.lit(1))
    names = [*keys, bucket]
    joined = rows.join(ends.withColumnRenamed("_first", "_rn"), [*names, "_rn"], "left")
    return joined.withColumn(out, F.coalesce("_prev", "_before")).drop("_prev", "_before", "_rn")


def running_total(df: DataFrame, keys: list, bucket: str, order: list, values: dict) -> DataFrame:
    """Add ``out`` = sum of the value over all earlier rows of (keys, order), for each {out: value}.

    The total of the earlier buckets comes from the summary, the rest from a
    window inside the bucket.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"_s_{o}") for o, v in values.items()])
    sums = sums.select(*keys, bucket, *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in values])
    rows = df.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{o}") for o, v in values.items()])
    joined = rows.join(sums, [*keys, bucket])
    return joined.select(*df.columns, *[(F.col(f"_b_{o}") + F.col(f"_i_{o}")).alias(o) for o in values])
