"""Reputation feed: verdict per raw provider answer, lookups per message."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dimensions as D
from ..functions.sqltext import pick, q
from .intents import finding
from .joins import lookup

VERDICT = pick([
    ("provider = 'VirusTotal'", pick([("malicious >= 2", "'malicious'"), ("malicious + suspicious > 0", "'suspicious'")],
                                     "'clean'")),
    ("provider = 'AbuseIPDB'", pick([("score >= 75", "'malicious'"), ("score >= 25", "'suspicious'")], "'clean'")),
    ("provider = 'URLScan'", "IF(malicious > 0, 'malicious', 'unknown')"),
    ("provider = 'Google Safe Browsing'", "IF(listed > 0, 'malicious', 'clean')"),
    ("provider = 'RDAP'", "IF(coalesce(datediff(to_date(feed_ts), to_date(registered)) < 30, false), 'suspicious', 'unknown')"),
], "'unknown'")


def with_verdict(feed: DataFrame) -> DataFrame:
    return feed.selectExpr("provider", "kind", "target", "to_timestamp(feed_ts) AS feed_ts", f"{VERDICT} AS verdict")


def latest(feed: DataFrame) -> DataFrame:
    """Newest answer per provider and target."""
    return with_verdict(feed).groupBy("provider", "kind", "target").agg(
        F.max_by("verdict", "feed_ts").alias("verdict"), F.max("feed_ts").alias("feed_ts"))


def targets(facts: DataFrame, max_domains: int | None = None) -> DataFrame:
    """What a message is looked up for: sender and link domains, then the address of the first relay.

    ``max_domains`` limits the domains of a message, for feeds that are paid by the question; all by default.
    """
    domains = ("filter(array_distinct(concat(array(coalesce(from_org, '')), transform(filter(links, l -> l.source <> "
               "'image'), l -> l.registrable))), d -> d <> '')")
    if max_domains is not None:
        domains = f"slice({domains}, 1, {max_domains})"
    ips = "array_compact(array(try_element_at(hops, 1).from_ip))"
    both = (f"concat(transform({domains}, (d, i) -> struct('domain' AS kind, i AS ord, d AS target)), "
            f"transform({ips}, (d, i) -> struct('ip' AS kind, i + 1000000 AS ord, d AS target)))")
    return facts.selectExpr("msg_id", "created_at", f"inline({both})")


def hits(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """Provider verdicts for the wanted targets; salted because one domain may appear in most messages."""
    keyed = wanted.selectExpr("*", "concat_ws('|', kind, target) AS _key")
    dim = answers.selectExpr("concat_ws('|', kind, target) AS _dkey", "provider", "verdict", "feed_ts")
    return lookup(keyed, dim, "_key", "_dkey", ["msg_id", "target"]).where("provider IS NOT NULL").drop("_key", "_dkey")


#: Parts of the messages that arrive for one target in one interval; each gets the target's few answers.
AS_OF_SALTS = 8


def as_of(wanted: DataFrame, feed: DataFrame, hours: int = 1) -> DataFrame:
    """Newest answer that is at most ``hours`` old when the message arrived.

    Messages and answers of a target are merged in time order, and the last
    answer of every provider is carried forward. The order is cut into intervals
    of ``hours`` and, within one, into salts; an answer goes into its own interval
    and the next one, where alone it can still be fresh.
    """
    width, micros = hours * 3_600_000_000, "unix_micros({})"
    asked = wanted.selectExpr("kind", "target", "created_at AS at", "1 AS asks", "msg_id", "CAST(NULL AS string) AS provider", "CAST(NULL AS string) AS verdict",
                              f"{micros.format('created_at')} div {width} AS slot", f"pmod(xxhash64(msg_id), {AS_OF_SALTS}) AS salt")
    told = with_verdict(feed).selectExpr("kind", "target", "feed_ts AS at", "0 AS asks", "CAST(NULL AS bigint) AS msg_id", "provider", "verdict",
                                         f"explode(array({micros.format('feed_ts')} div {width}, {micros.format('feed_ts')} div {width} + 1)) AS slot")
    told = told.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(AS_OF_SALTS - 1).cast("bigint"))))
    order = W.partitionBy("kind", "target", "slot", "salt").orderBy("at", "asks", "verdict").rowsBetween(W.unboundedPreceding, W.currentRow)
    names = [name for name, _ in D.PROVIDERS]
    last = [F.last(F.when((F.col("asks") == 0) & (F.col("provider") == n), F.struct("provider", "verdict", F.col("at").alias("feed_ts"))), ignorenulls=True)
            .over(order).alias(f"_{i}") for i, n in enumerate(names)]
    merged = asked.unionByName(told).select("kind", "target", "at", "asks", "msg_id", *last).where("asks = 1")
    answers = merged.select("msg_id", "kind", "target", "at", F.explode(F.array_compact(F.array(*[f"_{i}" for i in range(len(names))]))).alias("a"))
    return answers.where(f"a.feed_ts > at - INTERVAL {hours} HOURS").select("msg_id", "kind", "target", "a.provider", "a.verdict", "a.feed_ts").distinct()


def findings(found: DataFrame) -> DataFrame:
    """msg_id, ti array<finding> for malicious and suspicious answers."""
    order = pick([(f"provider = {q(name)}", str(i)) for i, (name, _) in enumerate(D.PROVIDERS)], "99")
    bad = "verdict = 'malicious'"
    f = finding(f"concat('threat_intel.', regexp_replace(lower(provider), '[^a-z0-9_]+', '_'))", "threat_intel",
                f"IF({bad}, 'critical', 'medium')", f"IF({bad}, 0.9D, 0.6D)",
                "concat(provider, ': ', target, ' reported ', verdict)", "threat_intel")
    rows = found.where("verdict IN ('malicious', 'suspicious')").selectExpr("msg_id", "ord", f"{order} AS p", f"{f} AS f")
    return rows.groupBy("msg_id").agg(F.expr("transform(array_sort(collect_list(struct(ord, p, f))), x -> x.f)").alias("ti"))
