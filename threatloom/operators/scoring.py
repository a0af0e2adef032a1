"""Trust context, score groups, model points, verdict."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dimensions as D
from ..functions.sqltext import steady, one_of, pick, q

DOWNGRADE = {"critical": "medium", "high": "low", "medium": "info", "low": "info", "info": "info"}
NEVER_DOWNGRADE = ["content.financial_request", "content.hidden_text"]


def points_of(severity: str) -> str:
    return pick([(f"{severity} = '{s}'", f"{float(p)}D") for s, p in D.SEVERITY_POINTS.items() if p], "0.0D")


def severity_rank(severity: str) -> str:
    """0 for the worst severity."""
    return pick([(f"{severity} = '{s}'", str(i)) for i, s in enumerate(D.SEVERITIES)], "9")


def cap_of(group: str) -> str:
    return pick([(f"{group} = '{g}'", f"{float(c)}D") for g, c in D.GROUP_CAPS.items()], f"{float(D.DEFAULT_GROUP_CAP)}D")


def label_of(group: str) -> str:
    return pick([(f"{group} = '{g}'", q(t)) for g, t in D.GROUP_LABELS.items()], group)


TRUST_PARTS = {
    "authenticated": "coalesce(dmarc_state = 'pass' AND coalesce(dmarc_aligned, true), false)",
    "sender_clean": "sender_lookalike IS NULL",
    "not_posing": "NOT exists(findings, f -> f.detector IN ('impersonation.homoglyph', 'impersonation.display_name'))",
    "links_at_home": "NOT exists(links, l -> l.source <> 'image' AND l.registrable <> '' AND l.registrable <> "
                     "coalesce(from_org, '') AND (sender_brand IS NULL OR NOT l.brand <=> sender_brand))",
    "links_harmless": "NOT exists(links, l -> l.risk_rank >= 4)",
    "files_harmless": "NOT exists(files, a -> a.risk_rank >= 4)",
    "no_password_form": "password_forms = 0",
}


def trusted() -> str:
    """Authenticated sender, nothing impersonating, links at home, nothing dangerous attached."""
    return " AND ".join(f"({p})" for p in TRUST_PARTS.values())


def downgrade(findings: str, trust: str) -> str:
    """Language findings of a trusted sender lose weight; the original severity stays on record."""
    soft = f"{trust} AND f.category = 'content' AND NOT {one_of('f.detector', NEVER_DOWNGRADE)}"
    lower = pick([(f"f.severity = '{a}'", q(b)) for a, b in DOWNGRADE.items()], "f.severity")
    new = f"IF({soft}, {lower}, f.severity)"
    return (f"transform({findings}, f -> struct(f.detector AS detector, f.category AS category, {new} AS severity, "
            "f.confidence AS confidence, f.title AS title, f.score_group AS score_group, f.evidence AS evidence, "
            f"nullif(f.severity, {new}) AS adjusted_from))")


def group_points(findings: str) -> str:
    """array<struct<group, points, n>>: each further finding of a group counts half as much, up to the cap."""
    pts = (f"sort_array(filter(transform(filter({findings}, f -> f.score_group = g), f -> {points_of('f.severity')} * "
           "f.confidence), p -> p > 0), false)")
    decayed = f"aggregate(transform({pts}, (p, i) -> p * power(0.5D, i)), 0.0D, (a, x) -> a + x)"
    return (f"filter(transform(array_distinct(transform({findings}, f -> f.score_group)), g -> struct(g AS group, "
            f"least({cap_of('g')}, {decayed}) AS points, size(filter({findings}, f -> f.score_group = g)) AS n)), "
            "x -> x.points > 0)")


def logit(p: str) -> str:
    clamped = f"least(greatest({p}, 1e-6D), 1 - 1e-6D)"
    return f"ln({clamped} / (1 - {clamped}))"


def model_confidence(p: str, t: str) -> str:
    margin = f"abs({logit(p)} - {logit(t)})"
    return f"CASE WHEN {margin} >= 3 THEN 'high' WHEN {margin} >= 1.2D THEN 'medium' ELSE 'low' END"


def model_points(p: str, t: str, confidence: str, rule_score: str, trust: str, critical: str) -> str:
    above = f"(6.0D + 14.0D * (({p} - {t}) / greatest(1e-6D, 1 - {t})))"
    above = f"({above} * IF({confidence} = 'low', 0.5D, 1.0D))"
    above = f"(IF({rule_score} < 10, least({above}, 8.0D), {above}) * IF({trust}, 0.25D, 1.0D))"
    below = f"IF({critical}, 0.0D, -8.0D * (({t} - {p}) / greatest(1e-6D, {t})))"
    return f"CASE WHEN {p} >= {t} THEN {above} ELSE {below} END"


def level_of(score: str) -> str:
    return pick([(f"{score} >= 80", "'critical'"), (f"{score} >= 60", "'high'"), (f"{score} >= 40", "'medium'"),
                 (f"{score} >= 20", "'low'")], "'safe'")


def class_of(score: str) -> str:
    return pick([(f"{score} >= 60", "'phishing'"), (f"{score} >= 35", "'suspicious'")], "'legitimate'")


def score(df: DataFrame) -> DataFrame:
    """Add the verdict to rows that carry findings, the trust inputs and the model score.

    ``findings`` is replaced by the trust-adjusted findings.
    """
    df = df.selectExpr("*", f"{trusted()} AS trusted")
    df = df.withColumn("findings", F.expr(downgrade("findings", "trusted")))
    df = df.selectExpr(
        "*", f"{group_points('findings')} AS _groups", "exists(findings, f -> f.severity = 'critical') AS _critical",
        "exists(findings, f -> f.severity = 'critical' AND f.confidence >= 0.9D) AS _strong",
        "size(array_distinct(transform(filter(findings, f -> f.severity IN ('critical', 'high')), f -> f.category))) AS _high")
    df = df.selectExpr("*", "least(100.0D, aggregate(_groups, 0.0D, (a, g) -> a + g.points)) AS _rule",
                       "CASE WHEN _high >= 4 THEN 12.0D WHEN _high >= 3 THEN 8.0D ELSE 0.0D END AS _bonus")
    df = df.selectExpr("*", f"{model_points('probability', 'threshold', 'model_confidence', '_rule', 'trusted', '_critical')} AS _mlp")
    df = df.selectExpr("*", "IF(abs(_mlp) >= 0.1D, _mlp, NULL) AS _ml")
    df = df.selectExpr("*", "_rule + _bonus + coalesce(_ml, 0.0D) AS _raw")
    df = df.selectExpr("*", "IF(_raw <= 0, 0.0D, 100.0D * (1 - exp(-_raw / 60.0D))) AS _curve")
    df = df.selectExpr("*", "_strong AND _curve < 60 AS _floor")
    df = df.selectExpr("*", "int(least(100, greatest(0, floor(round(IF(_floor, 60.0D, _curve), 6) + 0.5D)))) AS risk_score")

    def part(label, points, kind):
        return f"struct({label} AS label, {steady(points, 1)} AS points, '{kind}' AS kind)"

    parts = (f"concat(transform(_groups, g -> {part(label_of('g.group'), 'g.points', 'rule')}), array_compact(array("
             f"IF(_bonus > 0, {part(q('Independent evidence corroborates'), '_bonus', 'correlation')}, NULL), "
             f"IF(_ml IS NOT NULL, {part(q('Machine-learning assessment'), 'coalesce(_ml, 0.0D)', 'ml')}, NULL), "
             f"IF(trusted, {part(q('Trusted sender context'), '0.0D', 'trust')}, NULL), "
             f"IF(_floor, {part(q('Critical indicator floor'), '60.0D - _curve', 'correlation')}, NULL))))")
    df = df.selectExpr(
        "*", f"{level_of('risk_score')} AS risk_level", f"{class_of('risk_score')} AS classification",
        f"{steady('_rule', 1)} AS rule_score", f"{steady('greatest(0.0D, _raw)', 1)} AS raw_points",
        f"transform(array_sort(transform({parts}, (p, i) -> struct(-abs(p.points) AS k, i AS i, p AS p))), s -> s.p) AS contributions")
    df = df.selectExpr("*", f"{summary_text()} AS summary")
    return df.drop("_groups", "_critical", "_strong", "_high", "_rule", "_bonus", "_mlp", "_ml", "_raw", "_curve", "_floor")


def summary_text() -> str:
    ranked = ("array_sort(transform(filter(transform(findings, (f, i) -> struct(f AS f, i AS i)), x -> x.f.severity <> 'info'), "
              f"x -> struct(-({points_of('x.f.severity')} * x.f.confidence) AS k, x.i AS i, x.f.title AS t)))")
    lead = f"array_join(transform(slice({ranked}, 1, 3), x -> x.t), '; ')"
    return (
        "concat_ws(' ', concat(IF(risk_level = 'safe', 'No significant risk', concat(initcap(risk_level), ' risk')), "
        "' - classified ', classification, '.'), "
        f"coalesce(concat('Key evidence: ', nullif({lead}, ''), '.'), 'No rule-based indicators of phishing were found.'), "
        "concat('The ML classifier estimates ', floor(probability * 100 + 0.5D), '% phishing probability', "
        "IF((probability >= threshold) = (classification <> 'legitimate'), ', consistent with the rule evidence', "
        "', which the rule evidence does not support'), '.'), "
        "IF(trusted, 'The sender is authenticated and its links stay on its own domain.', NULL))")
