"""Link tables: deduplication, analysis against the host dimension, roll-up per message."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dimensions as D
from ..functions import urls as U
from ..functions.hosts import host_dimension
from ..functions.sqltext import one_of, q
from .intents import finding
from .joins import lookup


def dedup(candidates: DataFrame, max_per_message: int | None = None) -> DataFrame:
    """First occurrence per message and URL, anchors before forms before text before images.

    A minimum of a struct per key instead of a ranked window: it combines on
    the map side, so a URL repeated a million times in one message costs one row.
    """
    first = (candidates
             .where("url <> '' AND NOT (source = 'image' AND NOT url RLIKE '^(?i)https?:') "
                    "AND NOT (source = 'anchor' AND url RLIKE '^(?i)(?:mailto|tel|cid|#)')")
             .groupBy("msg_id", "url", F.expr("source = 'image'").alias("_img"))
             .agg(F.expr("min(struct(CASE source WHEN 'anchor' THEN 0 WHEN 'form' THEN 1 WHEN 'text' THEN 2 ELSE 3 END "
                         "AS src, pos, source, anchor_text))").alias("m")))
    out = first.selectExpr("msg_id", "m.src AS src_rank", "m.pos AS pos", "m.source AS source", "url",
                           "m.anchor_text AS anchor_text")
    if max_per_message:
        out = out.selectExpr("*", "row_number() OVER (PARTITION BY msg_id ORDER BY src_rank, pos) AS _n").where(
            f"_n <= {max_per_message}").drop("_n")
    return out


HOST_COLUMNS = ("host unicode_host registrable sub_levels is_idn mixed_script brand abused_tld shortener "
                "lookalike").split()


def analyse(links: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Parsed links with host facts (prefix h_), indicators and worst severity rank."""
    parsed = U.parse(links)
    if hosts is None:
        hosts = host_dimension(parsed.select("host"))
    dim = hosts.selectExpr(*[f"{c} AS h_{c}" for c in HOST_COLUMNS])
    return U.with_indicators(lookup(parsed, dim, "host", "h_host", ["msg_id", "url"]))


def per_message(analysed: DataFrame) -> DataFrame:
    """Links of a message as one ordered array. Bounded: a message is at most MAX_MESSAGE_BYTES long."""
    order = "src_rank" if "src_rank" in analysed.columns else "0"
    link = (f"struct({order} AS src_rank, pos, source, url, host, coalesce(h_registrable, '') AS registrable, "
            "h_brand AS brand, coalesce(h_mixed_script, false) AS mixed_script, risk_rank, indicators)")
    return analysed.groupBy("msg_id").agg(F.expr(f"array_sort(collect_list({link}))").alias("links"))


def matches(links: str, ids) -> str:
    """Matching indicators over all links that are not images, in link order."""
    return (f"flatten(transform(filter({links}, l -> l.source <> 'image'), l -> transform(filter(l.indicators, "
            f"i -> {one_of('i.id', ids)}), i -> struct(i.id AS id, {U.rank_of('i.severity')} AS rank, l.url AS url, "
            "l.host AS host, l.registrable AS registrable))))")


def match_column(detector: str) -> str:
    return "_m_" + detector.split(".")[1]


def with_matches(df: DataFrame) -> DataFrame:
    """Add one array column per URL detector, so that every rule reads its matches once."""
    return df.selectExpr("*", *[f"{matches('links', ids)} AS {match_column(d)}" for d, (_, ids) in D.URL_DETECTORS.items()],
                         f"{matches('links', ['credential_path', 'insecure_credential'])} AS _m_login")


def url_finding(detector: str) -> str:
    """One finding per detector and message, however many links match."""
    category, m = D.URL_DETECTORS[detector][0], match_column(detector)
    worst = f"array_max(transform({m}, x -> x.rank))"

    def has(name):
        return f"exists({m}, x -> x.id = '{name}')"

    severity = U.name_of(worst)
    if detector == "url.ip_host":
        confidence, title = "0.9D", f"IF({has('obfuscated_ip')}, 'Link to an obfuscated IP address', 'Link to a raw IP address')"
    elif detector == "url.obfuscation":
        confidence, title = "0.92D", f"IF({has('userinfo')}, {q('URL uses \"@\" to disguise its destination')}, 'Obfuscated URL')"
    elif detector == "url.redirect":
        confidence, title = "0.75D", f"IF({has('shortener')}, 'URL shortener hides the destination', 'Link redirects through another domain')"
    elif detector == "url.suspicious_tld":
        confidence, title = "0.6D", "'Links to high-risk domains'"
        severity = f"IF({worst} >= 3, 'medium', 'low')"
    elif detector == "url.lookalike_domain":
        confidence, title = f"IF({worst} >= 5, 0.95D, 0.82D)", "'Link to a look-alike domain'"
    else:
        confidence, title = "0.93D", "'Misleading link text'"
    evidence = (f"transform({m}, x -> concat(coalesce(nullif(x.registrable, ''), nullif(x.host, ''), 'URL'), "
                "' | ', x.url, ' | ', x.id))")
    return f"CASE WHEN size({m}) > 0 THEN {finding(detector, category, severity, confidence, title, 'url', evidence)} END"
