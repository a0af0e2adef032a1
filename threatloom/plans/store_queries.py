"""Detectors, scoring and the analyst's questions over stored results."""

import uuid

from pyspark.sql import functions as F

from .. import dimensions as D
from .. import fixtures as fx
from ..functions.sqltext import steady
from ..functions.urls import name_of
from ..operators import intents, links, reputation, results, scoring
from ..operators.detectors import explode_findings
from ..oracle.cte import s, steady_up, with_
from ..sources import store
from ..sources.shared import shared_dir
from .analysis import corpus_verdicts, gather
from .message_queries import span_sql
from .registry import query, stored


def _f(spark, d):
    return stored(spark, d, "findings")


def _v(spark, d):
    return stored(spark, d, "verdicts")


# ------------------------------------------------------------------ detectors
@query("det0_run_detectors", with_("findings_raw") + f"""
SELECT msg_id, 'f'||row_number() OVER (PARTITION BY msg_id ORDER BY ord) AS finding_id, detector, category, severity, confidence, title, score_group
FROM findings_raw""")
def det0(spark, d):
    """All findings numbered in registry order, with the severity the rule gave."""
    return _f(spark, d).selectExpr("msg_id", "finding_id", "detector", "category", "coalesce(adjusted_from, severity) AS severity",
                                   "confidence", "title", "score_group")


DETECTORS = [
    ("det1_auth_spf", "auth.spf"), ("det2_auth_dkim", "auth.dkim"), ("det3_auth_dmarc", "auth.dmarc"),
    ("det4_reply_to_mismatch", "header.reply_to_mismatch"), ("det5_return_path_mismatch", "header.return_path_mismatch"),
    ("det6_received_chain", "header.received_chain"), ("det7_header_anomalies", "header.anomalies"),
    ("det8_display_name", "impersonation.display_name"), ("det9_lookalike_sender", "impersonation.lookalike_sender"),
    ("det10_homoglyph", "impersonation.homoglyph"), ("det11_executive", "impersonation.executive"),
    ("det12_url_ip_host", "url.ip_host"), ("det13_url_obfuscation", "url.obfuscation"), ("det14_url_redirect", "url.redirect"),
    ("det15_url_suspicious_tld", "url.suspicious_tld"), ("det16_url_lookalike_domain", "url.lookalike_domain"),
    ("det17_url_anchor_mismatch", "url.anchor_mismatch"), ("det18_credential_harvesting", "url.credential_harvesting"),
    ("det19_urgency", "content.urgency"), ("det20_credential_request", "content.credential_request"),
    ("det21_financial_request", "content.financial_request"), ("det22_social_engineering", "content.social_engineering"),
    ("det23_scam_lure", "content.scam_lure"), ("det24_hidden_text", "content.hidden_text"),
    ("det25_dangerous_type", "attachment.dangerous_type"), ("det26_disguised_name", "attachment.disguised_name"),
    ("det27_type_mismatch", "attachment.type_mismatch"),
]


def _register(name, detector):
    @query(name, with_("rule_findings") + f"""
SELECT msg_id, severity, confidence, title, score_group FROM rule_findings WHERE detector = {s(detector)}""")
    def run(spark, d):
        return _f(spark, d).where(F.col("detector") == detector).selectExpr(
            "msg_id", "coalesce(adjusted_from, severity) AS severity", "confidence", "title", "score_group")


for _name, _det in DETECTORS:
    _register(_name, _det)


# ------------------------------------------------------------------ reputation
def _targets(spark, d):
    v = _v(spark, d).selectExpr("msg_id", "created_at", "sender_org AS from_org", "links", "hops")
    return reputation.targets(v)


@query("ti1_reputation_join", with_("ti_hits") + "SELECT msg_id, kind, target, provider, verdict FROM ti_hits")
def ti1(spark, d):
    feed = reputation.latest(fx.dim(spark, "dim_reputation"))
    return reputation.hits(_targets(spark, d), feed).select("msg_id", "kind", "target", "provider", "verdict")


@query("ti2_verdict_rules", with_("ti_targets", "feed") + """
SELECT f.provider, f.kind, f.target, strftime(f.feed_ts, '%Y-%m-%d %H:%M:%S') AS feed_ts, f.verdict, count(t.msg_id)::BIGINT AS messages
FROM feed f LEFT JOIN ti_targets t USING (kind, target) GROUP BY ALL""")
def ti2(spark, d):
    """Verdict of every raw answer and how many messages it concerns."""
    wanted = _targets(spark, d).groupBy("kind", "target").agg(F.count("*").alias("n"))
    return reputation.with_verdict(fx.dim(spark, "dim_reputation")).join(wanted, ["kind", "target"], "left").selectExpr(
        "provider", "kind", "target", "feed_ts", "verdict", "coalesce(n, 0) AS messages")


@query("ti3_fresh_lookup", with_("ti_targets", "feed", "messages") + """
SELECT t.msg_id, t.kind, t.target, f.provider, max_by(f.verdict, f.feed_ts) AS verdict,
  strftime(max(f.feed_ts), '%Y-%m-%d %H:%M:%S') AS feed_ts
FROM ti_targets t JOIN messages m USING (msg_id) JOIN feed f USING (kind, target)
WHERE f.feed_ts <= m.created_at AND f.feed_ts > m.created_at - INTERVAL 1 HOUR GROUP BY t.msg_id, t.kind, t.target, f.provider""")
def ti3(spark, d):
    return reputation.as_of(_targets(spark, d), fx.dim(spark, "dim_reputation"))


# ------------------------------------------------------------------ scoring
@query("sco1_trust_context", with_("trust") + "SELECT msg_id, trusted FROM trust")
def sco1(spark, d):
    return _v(spark, d).select("msg_id", "trusted")


@query("sco2_trust_downgrade", with_("findings") + """
SELECT msg_id, detector, title, original AS severity_from, severity AS severity_to FROM findings WHERE original <> severity""")
def sco2(spark, d):
    return _f(spark, d).where("adjusted_from IS NOT NULL").selectExpr(
        "msg_id", "detector", "title", "adjusted_from AS severity_from", "severity AS severity_to")


@query("sco3_group_decay", with_("group_scores") + "SELECT msg_id, score_group, round(points, 6) AS points, n::BIGINT AS n FROM group_scores")
def sco3(spark, d):
    return results.group_scores(_f(spark, d)).selectExpr("msg_id", "score_group", "round(points, 6) AS points", "n")


@query("sco4_rule_score", with_("verdicts") + "SELECT msg_id, rule_score::DOUBLE AS rule_score FROM verdicts")
def sco4(spark, d):
    total = results.group_scores(_f(spark, d)).groupBy("msg_id").agg(F.sum("points").alias("p"))
    return _v(spark, d).select("msg_id").join(total, "msg_id", "left").selectExpr(
        "msg_id", f"{steady('least(100.0D, coalesce(p, 0.0D))', 1)} AS rule_score")


@query("sco5_corroboration", with_("score1") + "SELECT msg_id, ncat::BIGINT AS categories, bonus::BIGINT AS bonus FROM score1")
def sco5(spark, d):
    n = "size(array_distinct(transform(filter(findings, f -> f.severity IN ('critical', 'high')), f -> f.category)))"
    return _v(spark, d).selectExpr("msg_id", f"{n} AS categories").selectExpr(
        "*", "CASE WHEN categories >= 4 THEN 12 WHEN categories >= 3 THEN 8 ELSE 0 END AS bonus")


@query("sco6_ml_points", with_("score1") + "SELECT msg_id, round(p, 6)::DOUBLE AS probability, conf AS confidence, round(ml, 6)::DOUBLE AS points FROM score1 WHERE p IS NOT NULL")
def sco6(spark, d):
    rule = results.group_scores(_f(spark, d)).groupBy("msg_id").agg(F.least(F.lit(100.0), F.sum("points")).alias("rule"))
    v = _v(spark, d).where("ml_probability IS NOT NULL").join(rule, "msg_id", "left").selectExpr(
        "msg_id", "ml_probability AS p", "ml_threshold AS t", "trusted", "critical_count > 0 AS crit", "coalesce(rule, 0.0D) AS rule")
    v = v.selectExpr("*", f"{scoring.model_confidence('p', 't')} AS confidence")
    v = v.selectExpr("*", f"{scoring.model_points('p', 't', 'confidence', 'rule', 'trusted', 'crit')} AS pts")
    return v.selectExpr("msg_id", "round(p, 6) AS probability", "confidence", "IF(abs(pts) >= 0.1D, round(pts, 6), NULL) AS points")


@query("sco7_saturate_floor", with_("verdicts") + "SELECT msg_id, raw_points::DOUBLE AS raw_points, strong, risk_score::BIGINT AS risk_score FROM verdicts")
def sco7(spark, d):
    return _v(spark, d).selectExpr("msg_id", "raw_points", "exists(findings, f -> f.severity = 'critical' AND f.confidence >= 0.9D) AS strong",
                                   "risk_score")


@query("sco8_bands", with_("verdicts") + "SELECT msg_id, risk_score::BIGINT AS risk_score, risk_level, classification FROM verdicts")
def sco8(spark, d):
    return _v(spark, d).selectExpr("msg_id", "risk_score", f"{scoring.level_of('risk_score')} AS risk_level",
                                   f"{scoring.class_of('risk_score')} AS classification")


@query("sco9_contributions", with_("verdicts", "group_scores", "dim_cap") + f"""
SELECT g.msg_id, c.label, {steady_up('g.points', 1)}::DOUBLE AS points, 'rule' AS kind FROM group_scores g JOIN dim_cap c USING (score_group)
UNION ALL SELECT msg_id, 'Independent evidence corroborates', bonus::DOUBLE, 'correlation' FROM verdicts WHERE bonus > 0
UNION ALL SELECT msg_id, 'Machine-learning assessment', {steady_up('ml', 1)}::DOUBLE, 'ml' FROM verdicts WHERE ml IS NOT NULL
UNION ALL SELECT msg_id, 'Trusted sender context', 0.0::DOUBLE, 'trust' FROM verdicts WHERE trusted
UNION ALL SELECT msg_id, 'Critical indicator floor', {steady_up('60 - curve', 1)}::DOUBLE, 'correlation' FROM verdicts WHERE strong AND curve < 60""")
def sco9(spark, d):
    return _v(spark, d).selectExpr("msg_id", "inline(contributions)")


@query("sco10_summary_text", with_("verdicts", "findings", "dim_sev") + """,
lead AS (SELECT msg_id, string_agg(title, '; ' ORDER BY k DESC, ord) AS titles FROM (
  SELECT f.msg_id, f.title, f.ord, v.points * f.confidence AS k, row_number() OVER (PARTITION BY f.msg_id ORDER BY v.points * f.confidence DESC, f.ord) AS rn
  FROM findings f JOIN dim_sev v USING (severity) WHERE f.severity <> 'info') WHERE rn <= 3 GROUP BY msg_id)
SELECT v.msg_id, concat_ws(' ', CASE WHEN risk_level = 'safe' THEN 'No significant risk' ELSE upper(risk_level[1])||risk_level[2:]||' risk' END
    ||' - classified '||classification||'.', coalesce('Key evidence: '||titles||'.', 'No rule-based indicators of phishing were found.'),
  'The ML classifier estimates '||floor(p*100+0.5)::BIGINT||'% phishing probability'||CASE WHEN (p >= t) = (classification <> 'legitimate')
    THEN ', consistent with the rule evidence' ELSE ', which the rule evidence does not support' END||'.',
  CASE WHEN trusted THEN 'The sender is authenticated and its links stay on its own domain.' END) AS summary
FROM verdicts v LEFT JOIN lead USING (msg_id)""")
def sco10(spark, d):
    return _v(spark, d).select("msg_id", "summary")


@query("sco11_findings_union", with_("rule_findings", "ti_findings") + """
SELECT msg_id, 'f'||row_number() OVER (PARTITION BY msg_id ORDER BY ord) AS id, detector, title FROM rule_findings
UNION ALL SELECT msg_id, 't'||row_number() OVER (PARTITION BY msg_id ORDER BY ord, title) AS id, detector, title FROM ti_findings""")
def sco11(spark, d):
    """Rule findings f1.. and reputation findings t1.. of every message."""
    parts = _v(spark, d).selectExpr("msg_id", "filter(findings, f -> f.category <> 'threat_intel') AS r",
                                    "filter(findings, f -> f.category = 'threat_intel') AS t")
    rules = parts.selectExpr("msg_id", "posexplode(r) AS (i, f)").selectExpr("msg_id", "concat('f', i + 1) AS id", "f.detector", "f.title")
    feed = parts.selectExpr("msg_id", "posexplode(t) AS (i, f)").selectExpr("msg_id", "concat('t', i + 1) AS id", "f.detector", "f.title")
    return rules.unionByName(feed)


# ------------------------------------------------------------------ questions
VERDICT_COLS = "msg_id, sender_address, subject, risk_score::BIGINT AS risk_score, risk_level, classification"
SPARK_COLS = ["msg_id", "sender_address", "subject", "risk_score", "risk_level", "classification"]


@query("qry1_search_filter", with_("verdicts") + f"""
SELECT {VERDICT_COLS} FROM verdicts WHERE contains(lower(subject), '[team]') OR contains(lower(sender_address), 'paypa')
  OR contains(lower(source_name), '7.eml')""")
def qry1(spark, d):
    v = _v(spark, d)
    return results.search(v, "[Team]").unionByName(results.search(v, "PAYPA")).unionByName(
        results.search(v, "7.eml")).select(*SPARK_COLS).distinct()


@query("qry1_search_wildcard", with_("verdicts") + f"SELECT {VERDICT_COLS} FROM verdicts WHERE contains(lower(subject), '%')")
def qry1w(spark, d):
    """A literal percent sign matches nothing but itself."""
    return results.search(_v(spark, d), "%").select(*SPARK_COLS)


@query("qry2_facet_filter", with_("verdicts") + f"""
SELECT {VERDICT_COLS} FROM verdicts WHERE risk_level IN ('critical', 'low') AND classification IN ('phishing', 'legitimate')""")
def qry2(spark, d):
    return results.facets(_v(spark, d), levels=["critical", "low"], classes=["phishing", "legitimate"]).select(*SPARK_COLS)


@query("qry3_date_range", with_("verdicts") + f"""
SELECT {VERDICT_COLS} FROM verdicts WHERE created_at >= TIMESTAMP '2024-01-03 00:00:00' AND created_at < TIMESTAMP '2024-01-06 00:00:00'""")
def qry3(spark, d):
    return results.date_range(_v(spark, d), "2024-01-03", "2024-01-05").select(*SPARK_COLS)


def _page(sort, order, page, size, extra=""):
    return with_("verdicts") + f"""SELECT {VERDICT_COLS}, (SELECT count(*) FROM verdicts)::BIGINT AS total FROM verdicts
ORDER BY {sort} {order}, msg_id DESC LIMIT {size} OFFSET {(page - 1) * size}"""


@query("qry4_page_sort", _page("risk_score", "DESC", 3, 25))
def qry4(spark, d):
    return results.page(_v(spark, d), sort="risk_score", order="desc", page=3, size=25).select(*SPARK_COLS, "total")


@query("qry4_page_sender", _page("sender_address", "ASC", 2, 40))
def qry4s(spark, d):
    return results.page(_v(spark, d), sort="sender_address", order="asc", page=2, size=40).select(*SPARK_COLS, "total")


@query("qry4_orders_page", """
SELECT o_orderkey, o_custkey, o_totalprice, count(*) OVER ()::BIGINT AS total FROM orders WHERE o_orderstatus IN ('F', 'O')
ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50 OFFSET 100""")
def qry4o(spark, d):
    """The same paging over another table."""
    o = fx.table(spark, d, "orders").where("o_orderstatus IN ('F', 'O')")
    return results.page(o, sort="o_totalprice", order="desc", page=3, size=50, key="o_orderkey", allowed=["o_totalprice"]).select(
        "o_orderkey", "o_custkey", "o_totalprice", "total")


@query("qry5_latest_feedback", with_("feedback", "verdicts") + """
SELECT v.msg_id, v.classification, f.verdict AS feedback FROM verdicts v LEFT JOIN (
  SELECT msg_id, max_by(verdict, id) AS verdict FROM feedback GROUP BY msg_id) f USING (msg_id)""")
def qry5(spark, d):
    return results.with_latest_feedback(_v(spark, d), stored(spark, d, "feedback")).select("msg_id", "classification", "feedback")


@query("qry5_latest_turn", """
SELECT conv_id, max(turn) AS last_turn, max_by(role, turn) AS last_role, md5(max_by(text, turn)) AS last_md5 FROM conversations GROUP BY conv_id""")
def qry5c(spark, d):
    """Latest child per parent over conversations."""
    return fx.table(spark, d, "conversations").groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.md5(F.max_by("text", "turn")).alias("last_md5"))


def _classes(names):
    return ", ".join(f"('{n}', {i})" for i, n in enumerate(names))


@query("qry6_count_by_class", with_("verdicts") + f"""
SELECT c.name AS classification, count(v.msg_id)::BIGINT AS n FROM (VALUES {_classes(D.CLASSIFICATIONS)}) c(name, k)
LEFT JOIN verdicts v ON v.classification = c.name GROUP BY c.name""")
def qry6(spark, d):
    return results.counts_by(_v(spark, d), "classification", D.CLASSIFICATIONS)


@query("qry7_count_by_level", with_("verdicts") + f"""
SELECT c.name AS risk_level, count(v.msg_id)::BIGINT AS n FROM (VALUES {_classes(D.RISK_LEVELS)}) c(name, k)
LEFT JOIN verdicts v ON v.risk_level = c.name GROUP BY c.name""")
def qry7(spark, d):
    return results.counts_by(_v(spark, d), "risk_level", D.RISK_LEVELS)


@query("qry6_qry7_grouping_sets", with_("verdicts") + """
SELECT classification, risk_level, count(*)::BIGINT AS n FROM verdicts GROUP BY GROUPING SETS ((classification), (risk_level))""")
def qry67(spark, d):
    """Both distributions in one pass."""
    return _v(spark, d).groupingSets([["classification"], ["risk_level"]], "classification", "risk_level").agg(
        F.count("*").alias("n")).select("classification", "risk_level", "n")


@query("qry8_category_counts", with_("findings") + """
SELECT category, count(*)::BIGINT AS n FROM findings WHERE severity <> 'info' GROUP BY category ORDER BY n DESC, category""")
def qry8(spark, d):
    return results.category_counts(_f(spark, d))


@query("qry9_top_indicators", with_("findings", "dim_sev") + f"""
SELECT title, count(*) FILTER (WHERE severity <> 'info')::BIGINT AS n, ([{', '.join(s(x) for x in D.SEVERITIES)}])[min(rank) + 1] AS severity
FROM findings JOIN dim_sev USING (severity) GROUP BY title HAVING count(*) FILTER (WHERE severity <> 'info') > 0 ORDER BY n DESC, title LIMIT 8""")
def qry9(spark, d):
    return results.top_indicators(_f(spark, d))


@query("qry10_critical_total", with_("findings") + "SELECT count(*) FILTER (WHERE severity = 'critical')::BIGINT AS critical_findings FROM findings")
def qry10(spark, d):
    return _f(spark, d).agg(F.count_if(F.col("severity") == "critical").alias("critical_findings"))


@query("qry11_daily_history", with_("verdicts") + """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (WHERE classification = 'phishing')::BIGINT AS phishing,
  count(*) FILTER (WHERE classification = 'suspicious')::BIGINT AS suspicious,
  count(*) FILTER (WHERE classification = 'legitimate')::BIGINT AS legitimate, count(v.msg_id)::BIGINT AS total
FROM (SELECT unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY)) AS day) c
LEFT JOIN verdicts v ON v.created_at::DATE = c.day::DATE GROUP BY day""")
def qry11(spark, d):
    return results.daily_history(_v(spark, d), today="2024-01-31", days=30)


@query("qry11_event_history", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(e.event_id)::BIGINT AS total, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors
FROM (SELECT unnest(generate_series(DATE '2023-12-31', DATE '2024-01-29', INTERVAL 1 DAY)) AS day) c LEFT JOIN events e ON e.ts::DATE = c.day::DATE GROUP BY day""")
def qry11e(spark, d):
    """Zero-filled calendar over events."""
    ev = fx.table(spark, d, "events").selectExpr("to_date(ts) AS day", "event_type").groupBy("day").agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return results.calendar(spark, "2024-01-29", 30).join(ev, "day", "left").selectExpr(
        "date_format(day, 'yyyy-MM-dd') AS day", "coalesce(total, 0) AS total", "coalesce(errors, 0) AS errors")


@query("qry12_feedback_totals", with_("feedback") + """
SELECT count(*)::BIGINT AS feedback_count, count(*) FILTER (WHERE verdict = 'false_positive')::BIGINT AS false_positives
FROM feedback WHERE id IN (SELECT max(id) FROM feedback GROUP BY msg_id)""")
def qry12(spark, d):
    return results.latest_feedback(stored(spark, d, "feedback")).agg(
        F.count("*").alias("feedback_count"), F.count_if(F.col("feedback") == "false_positive").alias("false_positives"))


@query("qry13_totals", with_("verdicts") + """
SELECT count(*)::BIGINT AS investigations, count(*) FILTER (WHERE classification = 'phishing')::BIGINT AS threats,
  count(*) FILTER (WHERE classification = 'suspicious')::BIGINT AS suspicious,
  count(*) FILTER (WHERE risk_level IN ('critical', 'high'))::BIGINT AS high_risk FROM verdicts""")
def qry13(spark, d):
    return _v(spark, d).agg(
        F.count("*").alias("investigations"), F.count_if(F.expr("classification = 'phishing'")).alias("threats"),
        F.count_if(F.expr("classification = 'suspicious'")).alias("suspicious"),
        F.count_if(F.expr("risk_level IN ('critical', 'high')")).alias("high_risk"))


@query("qry14_exists", with_("verdicts") + """
SELECT o.o_orderkey AS msg_id, EXISTS (SELECT 1 FROM verdicts v WHERE v.msg_id = o.o_orderkey) AS present FROM orders o""")
def qry14(spark, d):
    """Which of many ids are known."""
    ids = fx.table(spark, d, "orders").selectExpr("o_orderkey AS msg_id")
    return results.known(ids, _v(spark, d))


@query("qry15_severity_counts", with_("findings", "messages") + """
SELECT m.msg_id, """ + ", ".join(f"count(*) FILTER (WHERE f.severity = '{v}')::BIGINT AS {v}" for v in D.SEVERITIES) + """
FROM messages m LEFT JOIN findings f USING (msg_id) GROUP BY m.msg_id""")
def qry15(spark, d):
    counts = _f(spark, d).groupBy("msg_id").pivot("severity", D.SEVERITIES).agg(F.count(F.lit(1)))
    return _v(spark, d).select("msg_id").join(counts, "msg_id", "left").na.fill(0)


@query("qry16_top_findings", with_("findings", "dim_sev") + """
SELECT msg_id, rn::BIGINT AS place, detector, severity, confidence, title FROM (
  SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY rank, confidence DESC, ord) AS rn FROM findings JOIN dim_sev USING (severity)
  WHERE severity <> 'info') WHERE rn <= 6""")
def qry16(spark, d):
    return results.top_findings(_f(spark, d), 6)


@query("qry17_url_table", with_("link_risk") + """
SELECT msg_id, url, registrable, risk_rank::BIGINT AS risk_rank FROM link_risk
WHERE risk_rank > 0 AND (contains(lower(url), 'login') OR contains(lower(coalesce(anchor_text, '')), 'read') OR contains(lower(url), 'evil'))""")
def qry17(spark, d):
    a = links.analyse(links.dedup(fx.message_links(spark, d)))
    return a.where("risk_rank > 0 AND (contains(lower(url), 'login') OR contains(lower(coalesce(anchor_text, '')), 'read') "
                   "OR contains(lower(url), 'evil'))").selectExpr(
        "msg_id", "url", "coalesce(h_registrable, '') AS registrable", "risk_rank").orderBy(F.desc("risk_rank"), "registrable", "msg_id", "url")


@query("qry18_header_search", with_("headers") + """
SELECT msg_id, pos::BIGINT AS pos, name, value FROM headers WHERE contains(lower(name), 'spf') OR contains(lower(value), 'spf')""")
def qry18(spark, d):
    from ..functions import headers as H
    h = fx.messages(spark, d).selectExpr("msg_id", f"inline({H.header_array('header_block')})")
    return h.where("contains(lower(name), 'spf') OR contains(lower(value), 'spf')")


@query("qry19_ioc_extract", with_("link_risk", "facts", "hopflags", "file_risk") + """
SELECT msg_id, 'domain' AS kind, from_domain AS indicator FROM facts
UNION SELECT msg_id, 'domain', host FROM link_risk WHERE risk_rank > 0 AND host <> ''
UNION SELECT msg_id, 'url', url FROM link_risk WHERE risk_rank > 0
UNION SELECT msg_id, 'ip', from_ip FROM hopflags WHERE from_ip IS NOT NULL
UNION SELECT msg_id, 'sha256', sha256 FROM file_risk UNION SELECT msg_id, 'md5', md5 FROM file_risk""")
def qry19(spark, d):
    return results.indicators_of_compromise(_v(spark, d))


@query("qry20_recommendations", with_("findings", "dim_sev") + f""",
rec(prefix, text) AS (VALUES {', '.join(f"({s(p)}, {s(t)})" for p, t in results.RECOMMENDATIONS)}),
one AS (SELECT f.msg_id, r.text, min(rank::BIGINT * 1000000000 + ord) AS k FROM findings f JOIN dim_sev USING (severity) JOIN rec r ON starts_with(f.detector, r.prefix)
  WHERE f.severity <> 'info' GROUP BY f.msg_id, r.text)
SELECT msg_id, string_agg(text, ' | ' ORDER BY k) AS recommendations FROM one GROUP BY msg_id""")
def qry20(spark, d):
    return results.recommendations(_v(spark, d))


EDGES_SQL = with_("facts", "link_risk", "hopflags") + """,
e AS (
  SELECT msg_id, 'replies go to' AS relation, reply_domain AS dst, 4 AS level, 1 AS n FROM facts WHERE reply_domain <> ''
    AND array_to_string(string_split(reply_domain,'.')[-2:],'.') <> array_to_string(string_split(from_domain,'.')[-2:],'.')
  UNION ALL SELECT msg_id, 'bounces to', return_domain, CASE WHEN dmarc_state = 'pass' THEN 1 ELSE 2 END, 1 FROM facts WHERE return_domain <> ''
    AND array_to_string(string_split(return_domain,'.')[-2:],'.') <> array_to_string(string_split(from_domain,'.')[-2:],'.')
  UNION ALL SELECT msg_id, 'signed by', dkim_domain, 2, 1 FROM facts WHERE dkim_state <> 'not_present' AND dkim_domain IS NOT NULL
    AND array_to_string(string_split(dkim_domain,'.')[-2:],'.') <> array_to_string(string_split(from_domain,'.')[-2:],'.')
  UNION ALL SELECT msg_id, 'sent from', min_by(from_ip, hop), CASE WHEN min_by(no_rdns OR no_time OR backwards OR late, hop) THEN 2 ELSE 0 END, 1
    FROM hopflags WHERE from_ip IS NOT NULL GROUP BY msg_id
  UNION ALL SELECT msg_id, CASE WHEN registrable = from_two THEN 'links to (own domain)' ELSE 'links to' END, registrable, level, n FROM (
    SELECT l.msg_id, l.registrable, any_value(array_to_string(string_split(f.from_domain,'.')[-2:],'.')) AS from_two, max(risk_rank) AS level, count(*) AS n,
      row_number() OVER (PARTITION BY l.msg_id ORDER BY CASE WHEN max(risk_rank) = 0 THEN 99 ELSE max(risk_rank) END DESC, min(src_rank*1000+pos)) AS rn
    FROM link_risk l JOIN facts f USING (msg_id) WHERE l.source <> 'image' AND l.registrable <> '' GROUP BY l.msg_id, l.registrable) WHERE rn <= 6)
SELECT msg_id, relation, dst, (['none','info','low','medium','high','critical'])[level + 1] AS level, n::BIGINT AS n
FROM (SELECT *, count(*) OVER (PARTITION BY msg_id) AS c FROM e) WHERE c >= 2"""


@query("qry21_relation_edges", EDGES_SQL)
def qry21(spark, d):
    return results.relation_edges(_v(spark, d))


@query("qry22_message_timeline", with_("facts", "hopflags") + """
SELECT msg_id, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, label FROM (
  SELECT msg_id, date_ts AS moment, 'Date header (set by sender)' AS label FROM facts WHERE date_ts IS NOT NULL
  UNION ALL SELECT msg_id, ts, CASE WHEN row_number() OVER (PARTITION BY msg_id ORDER BY hop) = 1 THEN 'First relay' ELSE 'Relay hop '||hop END
    ||': '||coalesce(by_host, 'unknown') FROM hopflags WHERE ts IS NOT NULL
  UNION ALL SELECT msg_id, created_at, 'Analysed' FROM facts)""")
def qry22(spark, d):
    return results.timeline(_v(spark, d)).withColumnRenamed("at", "moment")


@query("qry23_evidence_segments", with_("messages") + span_sql() + """
, cuts AS (SELECT msg_id, 0::BIGINT AS c FROM messages UNION SELECT msg_id, length(text) FROM messages UNION SELECT msg_id, s FROM spans UNION SELECT msg_id, e FROM spans),
seg AS (SELECT msg_id, c AS a, lead(c) OVER (PARTITION BY msg_id ORDER BY c) AS b FROM cuts)
SELECT g.msg_id, a AS start, b AS "end", coalesce(string_agg(DISTINCT intent, ',' ORDER BY intent), '') AS intents
FROM seg g LEFT JOIN spans p ON p.msg_id = g.msg_id AND p.s <= a AND p.e >= b WHERE b IS NOT NULL GROUP BY g.msg_id, a, b""")
def qry23(spark, d):
    """Elementary text segments with the intents that cover them."""
    m = fx.messages(spark, d)
    return results.evidence_segments(m.selectExpr("msg_id", "length(text) AS length"), intents.spans_of(m))


@query("qry24_url_occurrences", """
SELECT page_id, (length(t) - length(replace(t, url, '')))::BIGINT // length(url) AS hits, instr(t, url)::BIGINT - 1 AS first_at FROM (
  SELECT page_id, url, 'Go to '||url||' or '||url||'; '||md5(url)||' '||url AS t FROM pages)""")
def qry24(spark, d):
    """Offsets of a URL in a body, from the pieces between its occurrences."""
    t = fx.table(spark, d, "pages").selectExpr("page_id AS msg_id", "url", "concat('Go to ', url, ' or ', url, '; ', md5(url), ' ', url) AS text")
    occ = results.occurrences(t)
    return occ.groupBy("msg_id").agg(F.count("*").alias("hits"), F.min("start").alias("first_at")).withColumnRenamed("msg_id", "page_id")


@query("qry25_expected_vs_verdict", with_("verdicts") + """
SELECT label, count(*) FILTER (WHERE classification = 'phishing')::BIGINT AS phishing, count(*) FILTER (WHERE classification = 'suspicious')::BIGINT AS suspicious,
  count(*) FILTER (WHERE classification = 'legitimate')::BIGINT AS legitimate FROM verdicts GROUP BY label""")
def qry25(spark, d):
    return _v(spark, d).groupBy("label").pivot("classification", D.CLASSIFICATIONS).agg(F.count(F.lit(1))).na.fill(0)


# ------------------------------------------------------------------ sources and sinks
@query("src4_source_registry", with_("messages") + """
SELECT source, label, pattern, licence, n::BIGINT AS messages FROM (VALUES ('phishing_pot', 'phishing', '*.eml', 'CC BY-NC 4.0'),
  ('spamassassin_ham', 'legitimate', '*.txt', 'Apache-2.0')) r(source, label, pattern, licence)
JOIN (SELECT label, count(*) AS n FROM messages GROUP BY label) USING (label)""")
def src4(spark, d):
    from ..sources.mail import registered_sources
    m = fx.messages(spark, d).selectExpr("IF(label = 'phishing', 'phishing_pot', 'spamassassin_ham') AS source").groupBy("source").agg(
        F.count("*").alias("messages"))
    return registered_sources(spark, m).join(m, "source")


@query("src5_get_by_id", with_("verdicts", "feedback") + f"""
SELECT {VERDICT_COLS}, summary_len, feedback FROM (SELECT *, finding_count::BIGINT AS summary_len,
  (SELECT f.verdict FROM feedback f WHERE f.msg_id = v.msg_id ORDER BY id DESC LIMIT 1) AS feedback FROM verdicts v) WHERE msg_id = 17""")
def src5(spark, d):
    v = results.by_id(_v(spark, d), 17)
    return results.with_latest_feedback(v, stored(spark, d, "feedback")).select(*SPARK_COLS, F.size("findings").alias("summary_len"), "feedback")


@query("src6_raw_fetch", with_("messages") + """
SELECT o.o_orderkey AS msg_id, CASE WHEN m.msg_id IS NULL THEN 'missing' WHEN m.html IS NULL THEN 'no body stored' ELSE 'ok' END AS state, m.html AS raw
FROM orders o LEFT JOIN messages m ON m.msg_id = o.o_orderkey""")
def src6(spark, d):
    """Raw body by id; a missing row and a null body are different answers."""
    ids = fx.table(spark, d, "orders").selectExpr("o_orderkey AS msg_id")
    return results.raw_of(ids, fx.messages(spark, d).selectExpr("msg_id", "html AS raw"))


@query("snk1_verdict_write", with_("verdicts", "findings") + """
SELECT 'verdicts' AS written, count(*)::BIGINT AS n FROM verdicts UNION ALL SELECT 'findings', count(*)::BIGINT FROM findings""")
def snk1(spark, d):
    """The whole pipeline, written as one wide and one long table."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/snk1_{abs(hash(d))}"
    store.write_verdicts(corpus_verdicts(spark, d), path)
    v, f = store.read_verdicts(spark, path), store.read_findings(spark, path)
    return v.agg(F.lit("verdicts").alias("written"), F.count("*").alias("n")).unionByName(
        f.agg(F.lit("findings").alias("written"), F.count("*").alias("n")))


def _sink(spark, name):
    """A fresh folder for what one run of a sink writes."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("snk4_feedback_append", with_("feedback", "messages") + """
SELECT verdict, reviewed::BIGINT AS reviewed, count(*)::BIGINT AS n FROM (SELECT verdict, reviewed FROM feedback
  UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'uncertain' ELSE 'confirmed_phishing' END, 0 FROM orders WHERE o_orderkey IN (SELECT msg_id FROM messages))
GROUP BY verdict, reviewed""")
def snk4(spark, d):
    """New feedback for order ids, written as a batch and once more, and read back: only ids with a stored verdict are accepted."""
    path, parents = _sink(spark, "snk4"), _v(spark, d)
    new = fx.table(spark, d, "orders").selectExpr("o_orderkey AS msg_id", "IF(o_orderkey % 2 = 0, 'uncertain', 'confirmed_phishing') AS verdict",
                                                  "1000000 + o_orderkey AS id")
    store.append_feedback(stored(spark, d, "feedback"), parents, path, "first")
    for _ in range(2):
        store.append_feedback(new, parents, path, "orders")
    return store.read_feedback(spark, path).groupBy("verdict", "reviewed").agg(F.count("*").alias("n"))


@query("snk5_delete_cascade", with_("verdicts", "findings", "feedback") + """
SELECT 'verdicts' AS tbl, count(*)::BIGINT AS n FROM verdicts WHERE classification <> 'suspicious'
UNION ALL SELECT 'findings', count(*)::BIGINT FROM findings WHERE msg_id NOT IN (SELECT msg_id FROM verdicts WHERE classification = 'suspicious')
UNION ALL SELECT 'feedback', count(*)::BIGINT FROM feedback WHERE msg_id NOT IN (SELECT msg_id FROM verdicts WHERE classification = 'suspicious')""")
def snk5(spark, d):
    """Suspicious messages leave three stored tables; what is left is counted from storage."""
    path, out = _sink(spark, "snk5"), None
    doomed = _v(spark, d).where("classification = 'suspicious'").select("msg_id")
    for name, t, part in (("verdicts", _v(spark, d), "month"), ("findings", _f(spark, d), "month"), ("feedback", stored(spark, d, "feedback"), "slot")):
        t = t.withColumn("slot", F.pmod("msg_id", F.lit(16))) if part == "slot" else t
        t.write.mode("overwrite").partitionBy(part).parquet(f"{path}/{name}")
        store.delete_cascade(doomed, f"{path}/{name}", part)
        one = spark.read.schema(t.schema).parquet(f"{path}/{name}").agg(F.lit(name).alias("tbl"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("snk6_report_export", with_("verdicts", "link_risk", "file_risk") + """
SELECT v.msg_id, v.risk_score::BIGINT AS score, v.classification, v.sender_address AS sender, v.finding_count::BIGINT AS findings,
  (SELECT count(*) FROM link_risk l WHERE l.msg_id = v.msg_id AND l.risk_rank > 0)::BIGINT AS ioc_urls,
  (SELECT count(*) FROM file_risk f WHERE f.msg_id = v.msg_id)::BIGINT AS ioc_files FROM verdicts v""")
def snk6(spark, d):
    """Report documents, written as JSON lines and read back field by field."""
    path = _sink(spark, "snk6")
    store.write_reports(results.reports(results.with_latest_feedback(_v(spark, d), stored(spark, d, "feedback"))), path)
    r = store.read_reports(spark, path, "report struct<analysisId: bigint>, verdict struct<riskScore: int, classification: string>, "
                           "emailMetadata struct<`from`: string>, indicators array<struct<title: string>>, "
                           "iocs struct<urls: array<string>, attachmentHashes: array<struct<sha256: string>>>")
    return r.selectExpr("report.analysisId AS msg_id", "verdict.riskScore AS score", "verdict.classification AS classification",
                        "emailMetadata.`from` AS sender", "size(indicators) AS findings", "size(iocs.urls) AS ioc_urls",
                        "size(iocs.attachmentHashes) AS ioc_files")
