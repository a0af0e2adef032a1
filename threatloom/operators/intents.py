"""Weighted intent phrases and the findings they lead to."""

from pyspark.sql import DataFrame

from .. import dimensions as D
from ..functions.sqltext import half_up, pick, q
from ..functions.text import ascii_words, contains_each

MASK = "\u0001"
ASKS = ["credential_request", "mfa_request", "payment_request", "gift_card", "bank_change"]


def may_hold(text: str, intent: str, k: int) -> str:
    """Whether a lower-case text has the words that a phrase needs; only such texts are searched."""
    return contains_each(text, D.INTENT_ANCHORS[intent][k], *[D.INTENT_ALSO[at] for at in [(intent, k)] if at in D.INTENT_ALSO])


def raw_scores(df: DataFrame, text: str = "text", subject: str = "subject") -> DataFrame:
    """Add ``raw_<intent>`` columns: each phrase adds its weight once per message.

    A phrase counts when it matches text that no earlier phrase of the same
    intent has claimed, or when it matches the subject. Claimed text is masked
    before the next phrase looks; one projection per phrase position keeps the
    expression from growing with depth, and a substring test guards each regex.
    """
    keep = list(df.columns)
    df = df.selectExpr("*", f"lower({text}) AS _low", f"lower({subject}) AS _subj",
                       *[f"0.0D AS raw_{i}" for i in D.INTENTS])
    body = {i: text for i in D.INTENTS}
    for level in range(max(len(p) for _, p in D.INTENTS.values())):
        live = [i for i, (_, p) in D.INTENTS.items() if level < len(p)]
        more = [i for i in live if level + 1 < len(D.INTENTS[i][1])]
        pattern = {i: q("(?i)" + ascii_words(D.INTENTS[i][1][level][0])) for i in live}
        hits = []
        for i in live:
            hits += [f"{may_hold('_low', i, level)} AND {body[i]} RLIKE {pattern[i]} AS _b_{i}",
                     f"{may_hold('_subj', i, level)} AND _subj RLIKE {pattern[i]} AS _s_{i}"]
        df = df.selectExpr("*", *hits)
        masked = [f"IF(_b_{i}, regexp_replace({body[i]}, {pattern[i]}, {q(MASK)}), {body[i]}) AS _t_{i}_{level + 1}"
                  for i in more]
        scores = [f"raw_{i} + IF(_b_{i} OR _s_{i}, {D.INTENTS[i][1][level][1]}D, 0.0D) AS raw_{i}" if i in live
                  else f"raw_{i}" for i in D.INTENTS]
        df = df.selectExpr(*keep, "_low", "_subj", *scores, *masked)
        body.update({i: f"_t_{i}_{level + 1}" for i in more})
    return df.select(*keep, *[f"raw_{i}" for i in D.INTENTS])


def in_context(df: DataFrame, call_to_action: str = "call_to_action") -> DataFrame:
    """Add ``score_<intent>``: raw scores boosted or damped by the intents around them, two decimals per step."""
    def has(*ids):
        return "(" + " OR ".join(f"raw_{i} > 0" for i in ids) + ")"

    hush = has("secrecy", "account_threat", "urgency")
    step = {i: f"raw_{i}" for i in D.INTENTS}
    boosts = [
        ("credential_request", call_to_action, 1.3), ("credential_request", has("account_threat"), 1.2),
        ("payment_request", hush, 1.3), ("gift_card", hush, 1.2), ("bank_change", hush, 1.2),
        ("urgency", f"NOT {has(*ASKS, 'account_threat')}", 0.5), ("authority", f"NOT {has(*ASKS, 'secrecy')}", 0.5)]
    for i, when, factor in boosts:
        step[i] = f"IF({when}, {half_up(f'{step[i]} * {factor}D', 2)}, {step[i]})"
    return df.selectExpr("*", *[f"{step[i]} AS score_{i}" for i in D.INTENTS])


def finding(detector, category, severity, confidence, title, group, evidence="CAST(array() AS array<string>)") -> str:
    """A finding struct. Severity, confidence and title are expressions; detector may be one too."""
    det = detector if "(" in detector else q(detector)
    return (f"struct({det} AS detector, '{category}' AS category, {severity} AS severity, "
            f"least(1.0D, greatest(0.0D, {confidence})) AS confidence, {title} AS title, '{group}' AS score_group, "
            f"{evidence} AS evidence)")


def fixed(detector, category, severity, confidence, title, group) -> str:
    """A finding whose severity, confidence and title never vary."""
    return finding(detector, category, q(severity), f"{confidence}D", q(title), group)


def with_rule_scores(df: DataFrame) -> DataFrame:
    """Add ``_rule_<n>``: combined score of the intents of every content rule."""
    return df.selectExpr("*", *[f"{' + '.join('score_' + i for i in intents)} AS _rule_{n}"
                                for n, (_, _, intents, _) in enumerate(D.INTENT_RULES)])


def intent_finding(n: int, spans: str | None = None) -> str:
    """Finding of a content rule; with quotes as evidence if there is a column of spans."""
    detector, title, ids, thresholds = D.INTENT_RULES[n]
    title = q(title)
    if detector == "content.financial_request":
        title = pick([("raw_bank_change > 0", q("Request to pay to changed bank details")),
                      ("raw_gift_card > 0", q("Gift card request"))], title)
    severity = pick([(f"_rule_{n} >= {minimum}D", q(s)) for s, minimum in thresholds])
    confidence = f"least(0.95D, {half_up(f'0.5D + _rule_{n} / 10', 2)})"
    return (f"CASE WHEN _rule_{n} >= {thresholds[-1][1]}D THEN "
            f"{finding(detector, 'content', severity, confidence, title, 'content', *([quotes_of(ids, spans)] if spans else []))} END")


def pressure_pattern() -> str:
    """Pressure, a request and a way to act on it at once."""
    ask = " OR ".join(f"raw_{i} > 0" for i in ASKS)
    return (f"CASE WHEN score_urgency + score_account_threat >= 2.0D AND ({ask}) AND (call_to_action OR raw_gift_card > 0 "
            "OR raw_bank_change > 0) THEN " + fixed(
                "content.social_engineering", "content", "high", 0.85, "Pressure + request + action pattern",
                "content_pattern") + " END")


def content_findings(spans: str | None = None) -> list:
    """Content rules in registry order; each is null when it does not apply."""
    rules = [intent_finding(n, spans) for n in range(len(D.INTENT_RULES))]
    return rules[:5] + [pressure_pattern()] + rules[5:]


SPAN = "array<struct<start: int, end: int, quote: string>>"


def matches(text: str, pattern: str) -> str:
    """array<struct<start, end, quote>> of all matches, offsets from the lengths of the pieces between them and of the matches before."""
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    lengths = f"transform(split({text}, {pattern}, -1), x -> length(x)) AS g, {found} AS m"
    start = "aggregate(slice(r.g, 1, i + 1), 0, (a, x) -> a + x) + aggregate(slice(r.m, 1, i), 0, (a, x) -> a + length(x))"
    return (f"filter(transform(array(struct({lengths})), r -> transform(transform(r.m, (x, i) -> struct(x AS quote, {start} AS start)), "
            "x -> struct(x.start AS start, x.start + length(x.quote) AS end, x.quote AS quote)))[0], x -> trim(x.quote) <> '')")


def with_spans(df: DataFrame, text: str = "text", max_spans: int | None = None) -> DataFrame:
    """Add ``spans``: array<struct<intent, start, end, quote>> of accepted phrase matches, offsets in code points.

    Phrases of an intent have an order; a match is accepted when it overlaps with
    none accepted before it. A substring test guards each expression, and offsets are taken only of texts that match.
    """
    keep, none = list(df.columns), f"CAST(array() AS {SPAN})"
    df = df.selectExpr("*", f"coalesce({text}, '') AS _text").selectExpr("*", "lower(_text) AS _low")
    full = "false" if max_spans is None else f"size(t) >= {max_spans}"
    cands, accepted = [], []
    for i, (_, phrases) in D.INTENTS.items():
        patterns = [q("(?i)" + ascii_words(p)) for p, _ in phrases]
        each = [f"IF({may_hold('_low', i, k)} AND _text RLIKE {p}, {matches('_text', p)}, {none})" for k, p in enumerate(patterns)]
        cands.append(f"flatten(array({', '.join(each)})) AS _c_{i}")
        taken = (f"aggregate(_c_{i}, {none}, (t, c) -> IF({full} OR exists(t, x -> c.start < x.end AND c.end > x.start), t, concat(t, array(c))))")
        accepted.append(f"transform({taken}, x -> struct({q(i)} AS intent, x.start AS start, x.end AS end, x.quote AS quote))")
    return df.selectExpr(*keep, *cands).selectExpr(*keep, f"flatten(array({', '.join(accepted)})) AS spans")


def spans_of(df: DataFrame, text: str = "text", max_spans: int | None = None) -> DataFrame:
    """One row per accepted phrase span: msg_id, intent, start, end (code points), quote."""
    return with_spans(df.select("msg_id", text), text, max_spans).selectExpr("msg_id", "inline(spans)")


def quotes_of(intents: list, spans: str = "spans", most: int = 6) -> str:
    """array<string> of the first distinct quotes of some intents, by place."""
    own = f"filter({spans}, x -> x.intent IN ({', '.join(map(q, intents))}))"
    return f"slice(array_distinct(transform(array_sort(transform({own}, x -> struct(x.start AS start, trim(x.quote) AS quote))), x -> x.quote)), 1, {most})"
