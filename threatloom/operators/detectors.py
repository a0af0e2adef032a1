"""The detector registry: every rule is an expression over one wide message row.

A rule yields a finding struct or null; the homoglyph rule yields an array. One
projection evaluates them all, so the message table is scanned once whatever
the number of rules.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dimensions as D
from ..functions import headers as H
from ..functions.hosts import clean_host, registrable
from ..functions.sqltext import array_of, one_of, pick, q
from ..functions.urls import name_of, rank_of
from . import links as L
from .intents import content_findings, finding, fixed, with_rule_scores


def when(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value} END"


def auth_rules():
    soft = "spf_result = 'softfail'"
    return [
        when("spf_state = 'fail'", finding("auth.spf", "authentication", f"IF({soft}, 'medium', 'high')", "0.95D",
                                           f"IF({soft}, 'SPF soft fail', 'SPF authentication failed')", "authentication")),
        when("dkim_state = 'fail'", fixed("auth.dkim", "authentication", "high", 0.9, "DKIM signature failed verification",
                                          "authentication")),
        pick([("dmarc_state = 'fail'", fixed("auth.dmarc", "authentication", "critical", 0.95,
                                             "DMARC failed for the From domain", "authentication")),
              ("dmarc_state = 'not_present' AND auth_headers = 0 AND from_domain <> ''",
               fixed("auth.dmarc", "authentication", "info", 1.0, "No authentication results recorded",
                     "authentication"))]),
    ]


def sender_rules():
    free = one_of("_reply_org", D.FREE_MAIL)
    ok = "dmarc_state = 'pass'"
    return [
        when("reply_domain <> '' AND from_org <> '' AND _reply_org <> from_org", finding(
            "header.reply_to_mismatch", "sender", f"IF({free} OR sender_lookalike IS NOT NULL, 'high', 'medium')", "0.85D",
            f"IF({free}, 'Replies diverted to a free-mail account', 'Reply-To differs from sender organisation')", "sender")),
        when("return_domain <> '' AND from_org <> '' AND _return_org <> from_org", finding(
            "header.return_path_mismatch", "sender", f"IF({ok}, 'info', 'low')", f"IF({ok}, 0.5D, 0.7D)",
            "'Return-Path domain differs from From domain'", "sender")),
    ]


def header_rules():
    def hops_with(flag):
        return f"exists(hops, h -> array_contains(h.flags, '{flag}'))"
    d = "header.anomalies"
    return [
        when(hops_with(H.BACKWARDS), fixed("header.received_chain", "header", "medium", 0.7,
                                           "Received chain timestamps go backwards", "header")),
        when(hops_with(H.NO_RDNS), fixed("header.received_chain", "header", "low", 0.6,
                                         "Sending server has no reverse DNS", "header")),
        when("_drift > 3600 OR _drift < -604800", fixed("header.received_chain", "header", "low", 0.6,
                                                        "Date header inconsistent with first relay", "header")),
        when(f"mailer RLIKE {q(D.SCRIPT_MAILERS)}", fixed(d, "header", "low", 0.6, "Sent with a scripting mail library",
                                                         "header")),
        when("from_count > 1", fixed(d, "header", "high", 0.9, "Multiple From headers", "sender")),
        when("message_id IS NULL AND from_address IS NOT NULL", fixed(d, "header", "info", 0.5, "Missing Message-ID",
                                                                      "header")),
    ]


def mentioned_brand(name: str, own: str) -> str:
    """First brand in registry order that a display name mentions and that the sender does not own."""
    return pick([(f"{name} RLIKE {q(p)} AND NOT {own} <=> {q(b)}", q(b)) for b, p in D.brand_mentions()])


def impersonation_rules():
    alike = "sender_lookalike IS NOT NULL"
    d, c = "impersonation.display_name", "impersonation"
    known = "from_name <> '' AND from_org <> ''"
    plain = [
        when(f"{known} AND _inside <> '' AND _inside_org <> from_org", fixed(
            d, c, "high", 0.9, "Display name contains a different email address", "impersonation")),
        when(f"{known} AND _mention IS NOT NULL", finding(
            d, c, f"IF({alike} OR dmarc_state = 'fail', 'critical', 'high')", f"IF({alike}, 0.95D, 0.85D)",
            "concat('Display name impersonates ', _mention)", "impersonation")),
        when(alike, finding("impersonation.lookalike_sender", "domain",
                            "IF(sender_lookalike.confidence >= 0.9D, 'critical', 'high')", "sender_lookalike.confidence",
                            "'Look-alike sender domain'", "impersonation")),
        when("sender_mixed_script", fixed("impersonation.homoglyph", c, "critical", 0.96, "Homoglyph sender domain",
                                          "impersonation")),
    ]
    hosts = ("array_distinct(transform(filter(links, l -> l.mixed_script AND l.host <> coalesce(from_domain, '')), "
             "l -> l.host))")
    per_host = finding("impersonation.homoglyph", c, "'critical'", "0.96D", "'Homoglyph link domain'", "impersonation",
                       "array(x)")
    executive = when(
        f"(coalesce(from_name RLIKE {q(D.EXECUTIVE_TITLE)}, false) OR mobile_signature) AND (raw_payment_request > 0 OR "
        "raw_gift_card > 0 OR raw_bank_change > 0) AND (raw_secrecy > 0 OR raw_urgency > 0)",
        finding("impersonation.executive", c, "'critical'", "IF(sender_free_mail OR reply_elsewhere, 0.9D, 0.75D)",
                "'Business email compromise pattern'", "impersonation"))
    return plain, f"transform({hosts}, x -> {per_host})", executive


def credential_harvesting() -> str:
    """Forms and login-style paths. Confidences and severities are this project's choice."""
    d = "url.credential_harvesting"
    return pick([
        ("password_forms > 0", fixed(d, "url", "critical", 0.97, "Password form in the message", "credential_form")),
        ("form_count > 0", fixed(d, "url", "high", 0.8, "Form in the message", "credential_form")),
        ("size(_m_login) > 0", fixed(d, "url", "medium", 0.6, "Login-style link on a non-brand domain", "url"))])


def hidden_content() -> str:
    return when("script_count > 0 OR hidden_count > 0", finding(
        "content.hidden_text", "content", "IF(script_count > 0, 'high', 'medium')", "0.8D",
        "IF(script_count > 0, 'Script content in HTML email', 'Hidden text in HTML body')", "content_hidden"))


def attachment_finding(detector: str) -> str:
    confidence, title, ids = D.ATTACHMENT_DETECTORS[detector]
    mine = one_of("i.id", ids)
    hits = f"filter(files, a -> exists(a.indicators, i -> {mine}))"
    ranks = f"flatten(transform(files, a -> transform(filter(a.indicators, i -> {mine}), i -> {rank_of('i.severity')})))"
    evidence = f"transform({hits}, a -> concat(a.filename, ' | ', a.sha256))"
    return when(f"size({ranks}) > 0", finding(detector, "attachment", name_of(f"array_max({ranks})"), f"{confidence}D",
                                              q(title), "attachment", evidence))


HELPERS = ["_reply_org", "_return_org", "_drift", "_inside", "_inside_org", "_mention", "_m_login"]


def run(df: DataFrame) -> DataFrame:
    """Add ``findings``: every rule finding of a message in registry order."""
    df = L.with_matches(with_rule_scores(df))
    inside = q(r"[\w.+-]+@([\w-]+(?:\.[\w-]+)+)")
    df = df.selectExpr(
        "*", f"{registrable('reply_domain')} AS _reply_org", f"{registrable('return_domain')} AS _return_org",
        "unix_timestamp(date) - unix_timestamp(try_element_at(hops, 1).ts) AS _drift",
        f"lower(regexp_extract(from_name, {inside}, 1)) AS _inside", f"{mentioned_brand('from_name', 'sender_brand')} AS _mention")
    df = df.selectExpr("*", f"{registrable(clean_host('_inside'))} AS _inside_org")
    plain, homoglyph_links, executive = impersonation_rules()
    first = array_of(*auth_rules(), *sender_rules(), *header_rules(), *plain)
    rest = array_of(executive, *[L.url_finding(d) for d in D.URL_DETECTORS], credential_harvesting(), *content_findings(),
                    hidden_content(), *[attachment_finding(d) for d in D.ATTACHMENT_DETECTORS])
    df = df.selectExpr("*", f"concat({first}, {homoglyph_links}, {rest}) AS findings")
    return df.drop(*HELPERS, *[L.match_column(d) for d in D.URL_DETECTORS],
                   *[f"_rule_{n}" for n in range(len(D.INTENT_RULES))])


def explode_findings(df: DataFrame, *carry: str) -> DataFrame:
    """One row per finding, numbered in registry order."""
    return df.select("msg_id", *carry, F.posexplode("findings").alias("pos", "f")).selectExpr(
        "msg_id", *carry, "concat('f', pos + 1) AS finding_id", "pos", "f.*")
