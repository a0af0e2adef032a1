"""From raw documents to shuffled training shards: five stages, each a Parquet table that the next one reads.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs. Toxic documents go, one document of each group of
near duplicates stays, documents that contain a benchmark item go, sources are
mixed to their weights (a document that is taken twice is two rows), and what is
left is shuffled into shards.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from threatloom.llm.common import read
from threatloom.llm.decontamination import without_items
from threatloom.llm.jaccard_join import one_of_each
from threatloom.llm.mixing import mixed_rows
from threatloom.llm.sharding import shard_rows
from threatloom.llm.toxicity import without_toxic
from threatloom.sources.shared import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are predicted toxic."""
    return without_toxic(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of linked texts."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return without_items(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target wants."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle documents into 24 shards; adds size, text_crc32, law, shard, slot and grown_shard."""
    return shard_rows(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing),
          ("sharding", sharding)]

#: SQL has no zstandard dictionaries; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; stages are written to the shared folder."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
