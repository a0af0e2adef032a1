"""Shared storage for tables that outlive a plan."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="threatloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate result by a table in shared storage.

    A table also has its true size. A checkpoint keeps the size that was
    estimated for its plan, and estimates that are multiplied join after join
    outgrow the driver in an iteration.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def rows_a_batch(spark: SparkSession, rows: int):
    """Large rows go to Python a few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input again when the session asks for it with ``threatloom.input.partitions``; as it was read by default.

    For tables of one small file that cannot be split. A cluster's tables have
    files enough and need no such exchange.
    """
    wanted = df.sparkSession.conf.get("threatloom.input.partitions", None)
    return df.repartition(int(wanted)) if wanted else df


_written: dict = {}


def table_once(spark: SparkSession, key: str, build) -> DataFrame:
    """Write a derived table once per application and read it back from then on."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{key.strip('/').replace('/', '_')}"
    if path not in _written:
        build().write.mode("overwrite").parquet(path)
        _written[path] = True
    return spread(spark.read.parquet(path))
