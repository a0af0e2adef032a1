"""Stored results: one wide verdict row per message, one row per finding, append-only feedback."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dimensions as D
from ..operators.detectors import explode_findings
from .shared import checkpointed


def verdict_rows(investigated: DataFrame) -> DataFrame:
    """Stored form of an investigated corpus; nested payload stays in separate columns."""
    def n_of(severity):
        return f"bigint(size(filter(findings, f -> f.severity = '{severity}')))"
    return investigated.selectExpr(
        "msg_id", "created_at", "to_date(created_at) AS day", "trunc(created_at, 'MM') AS month", "source_name", "coalesce(from_address, '') AS sender_address",
        "coalesce(from_domain, '') AS sender_domain", "from_org AS sender_org", "subject", "risk_score", "risk_level",
        "classification", "bigint(size(findings)) AS finding_count", f"{n_of('critical')} AS critical_count",
        f"{n_of('high')} AS high_count", "probability AS ml_probability", "threshold AS ml_threshold", "message_sha256",
        "size_bytes", "rule_score", "raw_points", "trusted", "contributions", "summary", "findings", "links", "files", "hops",
        "reply_to", "return_path", "dkim_domain", "dkim_state", "spf_state", "dmarc_state", "date", "label")


def write_verdicts(investigated: DataFrame, path: str, batch: str | None = None) -> None:
    """Write verdicts, then findings from the written verdicts, so both hold the same messages.

    The pipeline runs once. Each batch owns its folder and overwrites it, which
    makes a retried batch harmless. Files are balanced by size, so a busy month
    does not end up in one task. Folders are months and rows in a file stand by
    day: a folder a day would cost a file, a rename and a listing for some dozens of rows.
    """
    tail = f"/batch={batch}" if batch is not None else ""
    rows = verdict_rows(investigated)
    rows.hint("rebalance", "month").sortWithinPartitions("month", "day").write.mode("overwrite").partitionBy("month").parquet(f"{path}/verdicts{tail}")
    spark = investigated.sparkSession
    written = spark.read.parquet(f"{path}/verdicts{tail}")
    explode_findings(written, "created_at", "day", "month").write.mode("overwrite").partitionBy("month").parquet(f"{path}/findings{tail}")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/verdicts")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/findings")


def append_feedback(new: DataFrame, verdicts: DataFrame, path: str, batch: str) -> None:
    """Append the acceptable new rows as one batch: known verdict value, parent stored, not yet reviewed.

    A batch owns a folder, and counts once its line in the manifest is written
    after it. Running a batch again replaces it, so a retry adds nothing.
    """
    ok = new.where(F.col("verdict").isin(D.FEEDBACK_VERDICTS)).join(verdicts.select("msg_id"), "msg_id", "left_semi")
    if "reviewed" not in ok.columns:
        ok = ok.withColumn("reviewed", F.lit(0))
    ok.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    written = new.sparkSession.read.parquet(f"{path}/rows/batch={batch}")
    written.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches in the manifest, one small row a batch."""
    known = spark.read.parquet(f"{path}/manifest").select(F.col("batch").cast("string").alias("batch")).distinct()
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/rows")
    return rows.withColumn("batch", F.col("batch").cast("string")).join(known, "batch", "left_semi")


def delete_cascade(doomed: DataFrame, path: str, partition: str) -> None:
    """Remove the rows of doomed messages (column msg_id) from a stored table.

    Only partitions that hold such rows are written again, in one dynamic
    overwrite; partitions of which nothing is left are removed. Running it again
    finds nothing to do, so a retry after a failure completes the work.
    """
    spark = doomed.sparkSession
    table, keys = spark.read.parquet(path), doomed.select("msg_id").distinct()
    touched = checkpointed(table.join(keys, "msg_id", "left_semi").select(partition).distinct())
    kept = checkpointed(table.join(touched, partition, "left_semi").join(keys, "msg_id", "left_anti"))
    kept.select(table.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    empty = touched.join(kept.select(partition).distinct(), partition, "left_anti").collect()  # at most one row a partition folder
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in empty:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{partition}={r[0]}"), True)


def write_reports(documents: DataFrame, path: str) -> None:
    """Report documents as JSON lines, one message a line."""
    documents.select("report").write.mode("overwrite").text(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
