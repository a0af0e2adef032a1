"""What the operators of this package share: reading, word classes, joins of checked size, Arrow helpers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import BROADCAST_IDS, lookup, membership
from ..sources.shared import checkpointed

__all__ = ["BROADCAST_IDS", "attach", "byte_texts", "checkpointed", "membership", "pieces", "read", "space_words", "spans_of_blocks"]

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join with at most this many rows may be broadcast.
BROADCAST_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def space_words(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def attach(facts: DataFrame, dim: DataFrame, key: str, row_id: list, rows: int) -> DataFrame:
    """Left join to a dimension of ``rows`` rows, unique on ``key`` and never null there.

    Up to BROADCAST_ROWS rows it is broadcast; a larger one is joined by
    shuffle, with salted keys since one key may hold a third of the facts.
    """
    if rows <= BROADCAST_ROWS:
        return facts.join(F.broadcast(dim), key, "left")
    right = dim.withColumnRenamed(key, "_dim_key")
    return lookup(facts, right, key, "_dim_key", row_id).drop("_dim_key")


def byte_texts(batch: pa.RecordBatch, column: str) -> list:
    """Texts of an Arrow batch as bytes (null as empty)."""
    return [b"" if v is None else v for v in batch.column(column).cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column``, or one longer row; no row is lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(batch.column(column).cast(pa.binary()).to_pandas().map(lambda v: 0 if v is None else len(v)), dtype=np.int64)
        group = np.cumsum(lengths) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def spans_of_blocks(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose lengths add up to about ``limit``."""
    group = np.cumsum(lengths) // limit
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(lengths)])
