"""Versioned models with their metadata and metrics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "version string, trained_at timestamp, candidate string, threshold double, training_rows long"


def save(root: str, version: str, fitted, threshold: float, training_rows: int, metrics: DataFrame) -> None:
    """Model, feature space, metadata row and metrics under root/<version>."""
    spark = metrics.sparkSession
    path = f"{root}/{version}"
    fitted.model.write().overwrite().save(f"{path}/model")
    fitted.space.columns.write.mode("overwrite").parquet(f"{path}/columns")
    if fitted.space.vocab is not None:
        fitted.space.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
    if fitted.space.scale is not None:
        fitted.space.scale.write.mode("overwrite").parquet(f"{path}/scale")
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    meta = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("trained_at"), F.lit(fitted.key).alias("candidate"),
        F.lit(float(threshold)).alias("threshold"), F.lit(int(training_rows)).cast("long").alias("training_rows"))
    meta.write.mode("overwrite").json(f"{root}/metadata/model={version}")


def versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(META).json(f"{root}/metadata")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """Metadata row of the newest version."""
    return versions(spark, root).agg(F.max_by(F.struct("version", "trained_at", "candidate", "threshold", "training_rows"),
                                              F.struct("trained_at", "version")).alias("m")).select("m.*")


def load(spark: SparkSession, root: str, version: str | None = None):
    """(fitted, threshold) of a version, the newest by default. Logistic candidates only."""
    from pyspark.ml.classification import LogisticRegressionModel

    from .candidates import CANDIDATES, Fitted
    from .space import FeatureSpace
    row = (versions(spark, root).where(F.col("version") == version) if version else latest(spark, root)).first()
    if row is None or row["version"] is None:
        raise FileNotFoundError(f"no trained model under {root}")
    path, kinds = f"{root}/{row['version']}", CANDIDATES[row["candidate"]][2]
    columns = spark.read.parquet(f"{path}/columns")
    space = FeatureSpace(kinds, spark.read.parquet(f"{path}/vocabulary") if {"word", "char"} & set(kinds) else None,
                         spark.read.parquet(f"{path}/scale") if "structural" in kinds else None, columns, columns.count())
    return Fitted(row["candidate"], space, LogisticRegressionModel.load(f"{path}/model")), row["threshold"]
