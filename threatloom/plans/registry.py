"""Catalogue of named queries with their SQL counterparts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..sources import store
from ..sources.shared import shared_dir
from .analysis import corpus_verdicts

QUERIES: dict = {}
SQL: dict = {}


def plain(df: DataFrame) -> DataFrame:
    """Uniform output types: 64-bit integers, doubles, no time zones."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(spark, sf_dir))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return wrap


_stored: dict = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table of the investigated corpus, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = f"{shared_dir(spark)}/{key[0]}/store_{sf_dir.strip('/').replace('/', '_')}"
        store.write_verdicts(corpus_verdicts(spark, sf_dir), path)
        _stored[key] = path
    if name == "feedback":
        return fx.message_feedback(spark, sf_dir)
    return (store.read_verdicts if name == "verdicts" else store.read_findings)(spark, _stored[key])
