"""Questions over stored verdicts, findings and feedback."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dimensions as D
from ..functions.sqltext import pick, q
from ..functions.urls import name_of
from .scoring import points_of, severity_rank

# What to do about a finding, by detector family (first matching prefix).
RECOMMENDATIONS = [
    ("auth.", "Treat the sender as unverified and confirm through a known channel."),
    ("header.reply", "Do not reply; contact the sender at a known address."),
    ("header.return", "Trust only relay data added by your own servers."),
    ("header.received", "Trust only relay data added by your own servers."),
    ("header.anomalies", "Weigh together with sender authentication."),
    ("impersonation.", "Block the identity and search for other messages from it."),
    ("url.", "Do not open the links; block their hosts."),
    ("content.", "Verify the request by phone before acting on it."),
    ("attachment.", "Do not open the attachment; quarantine the message."),
    ("threat_intel.", "Block the indicator across mail and web gateways."),
]


def search(verdicts: DataFrame, text: str) -> DataFrame:
    """Case-insensitive literal substring of subject, sender or source, or an exact id or hash."""
    needle = text.lower()
    hit = F.lit(False)
    for c in ("subject", "sender_address", "source_name"):
        hit = hit | F.contains(F.lower(c), F.lit(needle))
    return verdicts.where(hit | (F.col("msg_id").cast("string") == text) | (F.col("message_sha256") == needle))


def facets(verdicts: DataFrame, levels=(), classes=()) -> DataFrame:
    """Keep the listed levels and classes; an empty list does not filter, an unknown value is refused."""
    for column, values, known in (("risk_level", levels, D.RISK_LEVELS), ("classification", classes, D.CLASSIFICATIONS)):
        unknown = set(values) - set(known)
        if unknown:
            raise ValueError(f"unknown {column}: {sorted(unknown)}")
        if values:
            verdicts = verdicts.where(F.col(column).isin(list(values)))
    return verdicts


def _of_months(verdicts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Leave out stored months before one date and after another; a table without months stays as it is."""
    if "month" in verdicts.columns:
        for sign, date in ((">=", start), ("<=", end)):
            verdicts = verdicts.where(f"month {sign} trunc({date}, 'MM')") if date else verdicts
    return verdicts


def date_range(verdicts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Start inclusive, end exclusive; a date without time as end includes the whole day. Prunes month partitions."""
    if start:
        verdicts = _of_months(verdicts, start=f"to_date(timestamp'{start}')")
        verdicts = verdicts.where(f"created_at >= timestamp'{start}' AND day >= to_date(timestamp'{start}')")
    if end:
        limit = f"timestamp'{end}'" + (" + INTERVAL 1 DAY" if len(end) == 10 else "")
        verdicts = _of_months(verdicts, end=f"to_date({limit})")
        verdicts = verdicts.where(f"created_at < {limit} AND day <= to_date({limit})")
    return verdicts


def page(rows: DataFrame, sort: str = "created_at", order: str = "desc", page: int = 1, size: int = 25, key: str = "msg_id",
         allowed=None) -> DataFrame:
    """One page plus the total; ties are broken by id, newest first. Only offset + size rows leave a task."""
    if sort not in (allowed or D.SORT_FIELDS):
        raise ValueError(f"cannot sort by {sort}")
    by = F.col(sort).asc() if order == "asc" else F.col(sort).desc()
    total = rows.agg(F.count("*").alias("total"))
    chosen = rows.orderBy(by, F.col(key).desc()).offset((page - 1) * size).limit(size)
    return chosen.withColumn("total", total.scalar())


def after(rows: DataFrame, sort: str, last_value, last_key, size: int = 25, key: str = "msg_id") -> DataFrame:
    """Next page after a known last row, descending; reads no earlier page."""
    later = (F.col(sort) < F.lit(last_value)) | ((F.col(sort) == F.lit(last_value)) & (F.col(key) < F.lit(last_key)))
    return rows.where(later).orderBy(F.col(sort).desc(), F.col(key).desc()).limit(size)


def latest_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("msg_id").agg(F.max_by("verdict", "id").alias("feedback"))


def with_latest_feedback(verdicts: DataFrame, feedback: DataFrame) -> DataFrame:
    return verdicts.join(latest_feedback(feedback), "msg_id", "left")


def by_id(verdicts: DataFrame, msg_id: int) -> DataFrame:
    return verdicts.where(F.col("msg_id") == msg_id)


def known(ids: DataFrame, verdicts: DataFrame) -> DataFrame:
    """ids(msg_id) with a flag whether a verdict is stored."""
    have = verdicts.select("msg_id").distinct().withColumn("_have", F.lit(True))
    return ids.join(have, "msg_id", "left").selectExpr("msg_id", "coalesce(_have, false) AS present")


def raw_of(ids: DataFrame, raw: DataFrame) -> DataFrame:
    """ids(msg_id) with state missing / no body stored / ok and the body."""
    have = raw.withColumn("_have", F.lit(True))
    return ids.join(have, "msg_id", "left").selectExpr(
        "msg_id", "CASE WHEN _have IS NULL THEN 'missing' WHEN raw IS NULL THEN 'no body stored' ELSE 'ok' END AS state", "raw")


def counts_by(verdicts: DataFrame, column: str, names: list) -> DataFrame:
    """Count per known value, absent values as zero, in one pass without a join."""
    wide = verdicts.agg(*[F.count_if(F.col(column) == n).alias(n) for n in names])
    pairs = ", ".join(f"{q(n)}, `{n}`" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS ({column}, n)")


def category_counts(findings: DataFrame) -> DataFrame:
    return findings.where("severity <> 'info'").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def top_indicators(findings: DataFrame, k: int = 8) -> DataFrame:
    """Most frequent titles with the worst severity over all their rows; one aggregation, top-k."""
    names = ", ".join(q(x) for x in D.SEVERITIES)
    return (findings.groupBy("title").agg(F.count_if(F.expr("severity <> 'info'")).alias("n"),
                                          F.min(F.expr(severity_rank("severity"))).alias("r"))
            .where("n > 0").orderBy(F.desc("n"), "title").limit(k)
            .selectExpr("title", "n", f"element_at(array({names}), r + 1) AS severity"))


def calendar(spark: SparkSession, today: str, days: int) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(date'{today}' - INTERVAL {days - 1} DAYS, date'{today}', INTERVAL 1 DAY)) AS day")


def daily_history(verdicts: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Zero-filled class counts of the last days."""
    recent = _of_months(verdicts, f"date'{today}' - INTERVAL {days} DAYS", f"date'{today}'")
    recent = recent.where(f"day > date'{today}' - INTERVAL {days} DAYS AND day <= date'{today}'")
    daily = recent.groupBy("day").agg(*[F.count_if(F.col("classification") == c).alias(c) for c in D.CLASSIFICATIONS],
                                      F.count("*").alias("total"))
    return calendar(verdicts.sparkSession, today, days).join(daily, "day", "left").na.fill(0).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd"))


def group_scores(findings: DataFrame) -> DataFrame:
    """msg_id, score_group, points, n: halving weights within a group, capped."""
    from .scoring import cap_of
    pts = f"({points_of('severity')} * confidence)"
    w = Window.partitionBy("msg_id", "score_group").orderBy(F.desc("p"), "pos")
    ranked = findings.selectExpr("msg_id", "score_group", "pos", f"{pts} AS p").withColumn("rn", F.row_number().over(w))
    return ranked.groupBy("msg_id", "score_group").agg(
        F.sum(F.expr("p * power(0.5D, rn - 1)")).alias("s"), F.count("*").alias("n")).selectExpr(
        "msg_id", "score_group", f"least({cap_of('score_group')}, s) AS points", "n").where("points > 0")


def top_findings(findings: DataFrame, k: int = 6) -> DataFrame:
    """Worst findings of every message. Groups are the findings of one message, so small."""
    w = Window.partitionBy("msg_id").orderBy("r", F.desc("confidence"), "pos")
    ranked = findings.where("severity <> 'info'").withColumn("r", F.expr(severity_rank("severity")))
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(
        "msg_id", "place", "detector", "severity", "confidence", "title")


def indicators_of_compromise(verdicts: DataFrame) -> DataFrame:
    """Distinct domains, risky URLs, relay addresses and attachment hashes per message; no shuffle."""
    risky = "filter(links, l -> l.risk_rank > 0)"
    parts = [
        ("domain", f"concat(array(sender_domain), transform(filter({risky}, l -> l.host <> ''), l -> l.host))"),
        ("url", f"transform({risky}, l -> l.url)"), ("ip", "transform(filter(hops, h -> h.from_ip IS NOT NULL), h -> h.from_ip)"),
        ("sha256", "transform(files, a -> a.sha256)"), ("md5", "transform(files, a -> a.md5)")]
    both = ", ".join(f"transform(array_distinct(filter({e}, x -> x <> '')), x -> struct('{k}' AS kind, x AS indicator))" for k, e in parts)
    return verdicts.selectExpr("msg_id", f"inline(concat({both}))")


def recommendation_of(detector: str) -> str:
    return pick([(f"startswith({detector}, {q(p)})", q(t)) for p, t in RECOMMENDATIONS])


def recommendations(verdicts: DataFrame) -> DataFrame:
    """Distinct advice per message, worst finding first."""
    ordered = (f"array_sort(transform(filter(transform(findings, (f, i) -> struct(f AS f, i AS i)), x -> x.f.severity <> 'info'), x -> "
               f"struct({severity_rank('x.f.severity')} AS r, x.i AS i, {recommendation_of('x.f.detector')} AS t)))")
    return verdicts.selectExpr("msg_id", f"array_join(array_distinct(transform({ordered}, x -> x.t)), ' | ') AS recommendations").where(
        "recommendations <> ''")


def relation_edges(verdicts: DataFrame, max_domains: int = 6) -> DataFrame:
    """Edges from a sender to the infrastructure its message touches; messages with at least two. No shuffle."""
    def two(x):
        return f"substring_index({x}, '.', -2)"
    own, bounce = two("sender_domain"), "substring_index(return_path, '@', -1)"
    dom = ("array_distinct(transform(filter(links, l -> l.source <> 'image' AND l.registrable <> ''), l -> l.registrable))")
    mine = "filter(links, l -> l.source <> 'image' AND l.registrable = x)"
    df = verdicts.selectExpr("*", f"transform({dom}, (x, i) -> struct(array_max(transform({mine}, l -> l.risk_rank)) AS level, "
                                  f"size({mine}) AS n, i AS i, x AS dst)) AS _d")
    ranked = f"slice(array_sort(transform(_d, x -> struct(IF(x.level = 0, -99, -x.level) AS k, x.i AS i, x AS x))), 1, {max_domains})"
    e = "struct({0} AS relation, {1} AS dst, {2} AS level, {3} AS n)"
    edges = "concat(" + ", ".join([
        f"transform(filter(reply_to, a -> {two('substring_index(a, ' + q('@') + ', -1)')} <> {own}), a -> "
        + e.format("'replies go to'", "substring_index(a, '@', -1)", "4", "1") + ")",
        f"array_compact(array(IF({two(bounce)} <> {own}, " + e.format("'bounces to'", bounce, "IF(dmarc_state = 'pass', 1, 2)", "1") + ", NULL), "
        f"IF(dkim_state <> 'not_present' AND {two('dkim_domain')} <> {own}, " + e.format("'signed by'", "dkim_domain", "2", "1") + ", NULL)))",
        "transform(slice(filter(hops, h -> h.from_ip IS NOT NULL), 1, 1), h -> "
        + e.format("'sent from'", "h.from_ip", "IF(size(h.flags) > 0, 2, 0)", "1") + ")",
        f"transform({ranked}, s -> " + e.format(f"IF(s.x.dst = {own}, 'links to (own domain)', 'links to')", "s.x.dst", "s.x.level", "s.x.n") + ")",
    ]) + ")"
    df = df.selectExpr("msg_id", f"{edges} AS _e").where("size(_e) >= 2")
    return df.selectExpr("msg_id", "inline(_e)").selectExpr("msg_id", "relation", "dst", f"{name_of('level')} AS level", "n")


def timeline(verdicts: DataFrame) -> DataFrame:
    """Date header, relays with a time, analysis, in time order."""
    hops = ("transform(filter(hops, h -> h.ts IS NOT NULL), (h, i) -> struct(h.ts AS at, concat(IF(i = 0, 'First relay', "
            "concat('Relay hop ', h.hop)), ': ', coalesce(h.by, 'unknown')) AS label))")
    all_ = (f"array_sort(concat(array_compact(array(IF(date IS NULL, NULL, struct(date AS at, 'Date header (set by sender)' AS label)))), {hops}, "
            "array(struct(created_at AS at, 'Analysed' AS label))))")
    return verdicts.selectExpr("msg_id", f"inline({all_})")


def evidence_segments(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Cut texts(msg_id, length) at every edge of spans(msg_id, intent, start, end).

    Every elementary segment lists the intents that cover it; neighbouring
    uncovered segments merge. Coverage is an interval test inside the message,
    whose spans are one bounded array, so no range join is needed.
    """
    per = spans.groupBy("msg_id").agg(F.collect_list(F.struct("start", "end", "intent")).alias("s"))
    df = texts.join(per, "msg_id", "left").selectExpr("msg_id", "length", "filter(s, x -> x.end <= length AND x.start < x.end) AS s")
    df = df.selectExpr("msg_id", "coalesce(s, slice(array(struct(0 AS start, 0 AS end, '' AS intent)), 1, 0)) AS s", "length")
    cuts = "array_sort(array_distinct(concat(array(0, length), transform(s, x -> x.start), transform(s, x -> x.end))))"
    df = df.selectExpr("msg_id", "s", f"{cuts} AS c")
    seg = ("transform(slice(c, 1, greatest(size(c) - 1, 0)), (a, i) -> struct(a AS start, c[i + 1] AS end, array_join(array_sort(array_distinct("
           "transform(filter(s, x -> x.start <= a AND x.end >= c[i + 1]), x -> x.intent))), ',') AS intents))")
    df = df.selectExpr("msg_id", f"{seg} AS g")
    merged = ("filter(transform(g, (x, i) -> struct(x.start AS start, IF(x.intents = '' , coalesce(array_min(transform(filter(g, y -> y.start >= x.end AND "
              "y.intents <> ''), y -> y.start)), element_at(g, -1).end), x.end) AS end, x.intents AS intents, "
              "x.intents = '' AND i > 0 AND try_element_at(g, nullif(i, 0)).intents = '' AS drop)), x -> NOT coalesce(x.drop, false))")
    return df.selectExpr("msg_id", f"inline({merged})").select("msg_id", "start", "end", "intents")


def occurrences(texts: DataFrame) -> DataFrame:
    """Start and end of every occurrence of ``url`` in ``text``, from the pieces between them."""
    pieces = "split(text, concat('\\\\Q', url, '\\\\E'), -1)"
    df = texts.selectExpr("msg_id", "url", f"transform({pieces}, p -> length(p)) AS n")
    at = ("transform(slice(n, 1, size(n) - 1), (p, i) -> aggregate(slice(n, 1, i + 1), i * length(url), (a, x) -> a + x))")
    return df.where("size(n) > 1").selectExpr("msg_id", "url", f"explode({at}) AS start").selectExpr(
        "msg_id", "url", "start", "start + length(url) AS end")


def reports(verdicts: DataFrame) -> DataFrame:
    """One JSON report document per message."""
    risky = "filter(links, l -> l.risk_rank > 0)"
    doc = F.expr(f"""to_json(struct(
      struct('Email security investigation report' AS title, msg_id AS analysisId, created_at AS generatedAt) AS report,
      summary AS executiveSummary,
      struct(risk_score AS riskScore, risk_level AS riskLevel, classification, rule_score AS ruleScore, contributions AS scoreBreakdown,
             trusted AS trustedSenderContext) AS verdict,
      struct(sender_address AS `from`, reply_to AS replyTo, return_path AS returnPath, subject, date, message_sha256 AS sha256,
             size_bytes AS sizeBytes) AS emailMetadata,
      struct(spf_state AS spf, dkim_state AS dkim, dmarc_state AS dmarc) AS authentication,
      struct(hops AS receivedChain) AS headerAnalysis,
      array_sort(findings, (a, b) -> {severity_rank('a.severity')} - {severity_rank('b.severity')}) AS indicators,
      links AS urlAnalysis, files AS attachmentAnalysis, struct(ml_probability AS probability, ml_threshold AS threshold) AS machineLearning,
      struct(array_distinct(concat(array(sender_domain), transform({risky}, l -> l.host))) AS domains, transform({risky}, l -> l.url) AS urls,
             array_distinct(transform(filter(hops, h -> h.from_ip IS NOT NULL), h -> h.from_ip)) AS ips,
             transform(files, a -> struct(a.filename AS filename, a.sha256 AS sha256, a.md5 AS md5)) AS attachmentHashes) AS iocs,
      feedback AS analystFeedback))""")
    return verdicts.select("msg_id", doc.alias("report"))
