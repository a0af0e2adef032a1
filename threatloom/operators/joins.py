"""Joins that survive hot keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: A set of 64-bit ids of at most this size may be broadcast.
BROADCAST_IDS = 500_000


def lookup(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, row_id: list, salts: int = SALTS) -> DataFrame:
    """Left join of a large fact table to a dimension that is unique on ``dim_key``.

    The fact key may be badly skewed (one host can carry a third of all
    links), so facts are spread over ``salts`` sub-keys and the dimension is
    repeated per sub-key. Both sides reach the join through a plain exchange,
    which leaves adaptive execution free to broadcast a small dimension or to
    split what is still too large.
    """
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int"))
    salted_dim = dim.withColumn("_dsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = (F.col(key) == F.col(dim_key)) & (F.col("_salt") == F.col("_dsalt"))
    return salted_facts.join(salted_dim, cond, "left").drop("_salt", "_dsalt")


def membership(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Left semi or anti join of texts to a stored table of ids under its one column's name.

    Up to BROADCAST_IDS ids are broadcast, so that texts stay where they are;
    more are joined by shuffle.
    """
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ids.columns, how)
