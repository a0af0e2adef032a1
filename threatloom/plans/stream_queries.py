"""Streaming jobs over the derived tables; what they wrote is read back."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import reputation
from ..oracle.cte import with_
from ..sources import store
from ..sources.shared import shared_dir
from ..streaming import jobs
from .registry import query, stored

_runs = 0


def _place(spark):
    """A fresh folder for one run."""
    global _runs
    _runs += 1
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream_{_runs}"


def _as_stream(spark, df, place):
    """Write a table and open it as a stream."""
    df.write.mode("overwrite").parquet(f"{place}/in")
    return spark.readStream.schema(spark.read.parquet(f"{place}/in").schema).parquet(f"{place}/in")


def arriving(spark, d):
    """Messages with their links, files and model score in one row."""
    links = fx.message_links(spark, d).groupBy("msg_id").agg(F.collect_list(F.struct("pos", "source", "url", "anchor_text")).alias("candidates"))
    files = fx.message_files(spark, d).groupBy("msg_id").agg(
        F.collect_list(F.struct("pos", "filename", "content", "declared_type")).alias("attachments"))
    return fx.messages(spark, d).join(links, "msg_id", "left").join(files, "msg_id", "left").join(fx.model_scores(spark, d), "msg_id", "left")


@query("str1_online_scoring", with_("verdicts") + """
SELECT classification, risk_level, count(*)::BIGINT AS n, sum(finding_count)::BIGINT AS findings FROM verdicts GROUP BY ALL""")
def str1(spark, d):
    """The same verdicts as the batch job."""
    place = _place(spark)
    stream = _as_stream(spark, arriving(spark, d), place)
    jobs.score_messages(stream, fx.dim(spark, "dim_reputation"), f"{place}/out", f"{place}/cp")
    return store.read_verdicts(spark, f"{place}/out").groupBy("classification", "risk_level").agg(
        F.count("*").alias("n"), F.sum("finding_count").alias("findings"))


@query("str2_ttl_lookup", with_("ti_targets", "messages").replace("WITH ", "WITH RECURSIVE ", 1) + """
, asked AS (SELECT DISTINCT kind, target, created_at AS t FROM ti_targets JOIN messages USING (msg_id)
  WHERE created_at < (SELECT max(created_at) FROM ti_targets JOIN messages USING (msg_id)) - INTERVAL 1 HOUR),
looked AS (SELECT kind, target, min(t) AS t FROM asked GROUP BY kind, target
  UNION ALL SELECT l.kind, l.target, min(a.t) FROM looked l JOIN asked a USING (kind, target) WHERE a.t >= l.t + INTERVAL 1 HOUR GROUP BY l.kind, l.target)
SELECT kind, target, strftime(t, '%Y-%m-%d %H:%M:%S') AS asked_at FROM looked""")
def str2(spark, d):
    """Lookups of indicators: the first one, and each when the last is an hour old; up to the watermark."""
    place = _place(spark)
    v = stored(spark, d, "verdicts").selectExpr("msg_id", "created_at", "sender_org AS from_org", "links", "hops")
    stream = _as_stream(spark, reputation.targets(v), place)
    jobs.to_table(jobs.lookups_within(stream, "created_at", ["kind", "target"]), f"{place}/out", f"{place}/cp")
    return spark.read.parquet(f"{place}/out")


def _events(spark, d, place):
    ev = fx.table(spark, d, "events").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type")
    return _as_stream(spark, ev, place)


@query("str3_burst_rate", """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, user_id, n FROM (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS s, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL)
WHERE n > 30""")
def str3(spark, d):
    """More than thirty events per client and minute."""
    place = _place(spark)
    jobs.to_table(jobs.bursts(_events(spark, d, place), "ts", "user_id"), f"{place}/out", f"{place}/cp")
    return spark.read.parquet(f"{place}/out")


@query("str3_busy_days", """
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, user_id, n FROM (
  SELECT date_trunc('day', ts) AS s, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL)
WHERE n > 4 AND s + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def str3d(spark, d):
    """Clients with more than four events a day; days that the watermark has passed."""
    place = _place(spark)
    busy = jobs.bursts(_events(spark, d, place), "ts", "user_id", more_than=4, width="1 day", delay="1 hour")
    jobs.to_table(busy, f"{place}/out", f"{place}/cp")
    return spark.read.parquet(f"{place}/out")


@query("str4_daily_counts_stream", with_("verdicts") + """
SELECT strftime(created_at, '%Y-%m-%d') AS day, classification, count(*)::BIGINT AS n FROM verdicts
WHERE date_trunc('day', created_at) + INTERVAL 1 DAY <= (SELECT max(created_at) FROM verdicts) - INTERVAL 1 DAY GROUP BY ALL""")
def str4(spark, d):
    """Daily class counts; days that the watermark has passed."""
    place = _place(spark)
    stream = _as_stream(spark, stored(spark, d, "verdicts").select("created_at", "classification"), place)
    jobs.to_table(jobs.daily_counts(stream, "created_at", "classification"), f"{place}/out", f"{place}/cp")
    return spark.read.parquet(f"{place}/out").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "classification", "n")
