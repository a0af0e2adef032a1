"""Domains, URLs and their indicators."""

from pyspark.sql import functions as F

from .. import dimensions as D
from .. import fixtures as fx
from ..functions import hosts as HO
from ..functions import text as X
from ..functions import urls as U
from ..functions.sqltext import one_of as among
from ..functions.sqltext import q
from ..operators import links
from ..oracle.cte import TESTS, leet, one_of, org, s, skel, with_
from .analysis import header_facts
from .registry import query


def _hosts(spark, d):
    """Hosts of links and senders."""
    linked = U.parse(fx.message_links(spark, d)).select("host")
    senders = header_facts(fx.messages(spark, d)).select(F.col("from_domain").alias("host"))
    return linked.unionByName(senders)


def _dim(spark, d):
    return HO.host_dimension(_hosts(spark, d))


def _analysed(spark, d):
    return links.analyse(links.dedup(fx.message_links(spark, d)))


PAGE_HOST = "lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1))"


@query("dom1_domain_info", with_("host_facts") + """
SELECT host, registrable, label, subdomain, public_suffix, isip AS is_ip, is_idn, uhost AS unicode_host FROM host_facts""")
def dom1(spark, d):
    return _dim(spark, d).select("host", "registrable", "label", "subdomain", "public_suffix", "is_ip", "is_idn", "unicode_host")


@query("dom1_page_hosts", f"""
SELECT host, {org('host')} AS registrable, count(*)::BIGINT AS pages FROM (SELECT {PAGE_HOST} AS host FROM pages) GROUP BY host""")
def dom1_pages(spark, d):
    hosts = U.parse(fx.table(spark, d, "pages").select("url")).groupBy("host").agg(F.count("*").alias("pages"))
    return hosts.selectExpr("host", f"{HO.registrable('host')} AS registrable", "pages")


@query("dom2_last_two_labels", f"""
SELECT last_two, count(*)::BIGINT AS n FROM (SELECT array_to_string(string_split({PAGE_HOST}, '.')[-2:], '.') AS last_two FROM pages) GROUP BY last_two""")
def dom2(spark, d):
    p = U.parse(fx.table(spark, d, "pages").select("url"))
    return p.selectExpr("substring_index(host, '.', -2) AS last_two").groupBy("last_two").agg(F.count("*").alias("n"))


@query("dom3_edit_distance", with_("host_facts", "dim_keyword") + """
SELECT host, kw, CASE WHEN levenshtein(label, kw) <= 2 THEN levenshtein(label, kw) ELSE 3 END::BIGINT AS distance
FROM host_facts, dim_keyword WHERE length(label) >= 5 AND length(kw) >= 5 AND NOT isip""")
def dom3(spark, d):
    """Distance to every brand keyword with a cut-off; beyond it the limit plus one."""
    words = ", ".join(q(k) for _, k, _ in D.brand_keywords() if len(k) >= 5)
    return _dim(spark, d).where("length(label) >= 5 AND NOT is_ip").selectExpr("host", "label", f"explode(array({words})) AS kw").selectExpr(
        "host", "kw", "IF(levenshtein(label, kw, 2) < 0, 3, levenshtein(label, kw, 2)) AS distance")


@query("dom4_skeleton", with_("host_facts") + f"SELECT host, {skel('uhost')} AS unicode_skeleton, {leet(skel('uhost'))} AS skeleton FROM host_facts")
def dom4(spark, d):
    return _dim(spark, d).selectExpr("host", f"{HO.latin_skeleton('unicode_host')} AS unicode_skeleton",
                                     f"{HO.substitute(HO.latin_skeleton('unicode_host'))} AS skeleton")


@query("dom5_script_mix", with_("host_facts") + "SELECT host, is_idn, mixed_script FROM host_facts")
def dom5(spark, d):
    return _dim(spark, d).select("host", "is_idn", "mixed_script")


@query("dom6_idn_decode", with_("host_facts") + "SELECT host, uhost AS unicode_host FROM host_facts WHERE is_idn")
def dom6(spark, d):
    return _dim(spark, d).where("is_idn").select("host", "unicode_host")


@query("dom7_lookalike", with_("host_facts", "lookalike") + """
SELECT h.host, l.like_brand AS brand, l.kw AS keyword, l.technique, l.conf AS confidence FROM host_facts h LEFT JOIN lookalike l USING (host)""")
def dom7(spark, d):
    return _dim(spark, d).selectExpr("host", "lookalike.brand AS brand", "lookalike.keyword AS keyword",
                                     "lookalike.technique AS technique", "lookalike.confidence AS confidence")


@query("dom8_official_brand", with_("host_facts") + "SELECT host, registrable, brand FROM host_facts")
def dom8(spark, d):
    return _hosts(spark, d).where("host <> ''").distinct().selectExpr("host", f"{HO.registrable('host')} AS registrable").selectExpr(
        "*", f"{HO.official_brand('registrable')} AS brand")


@query("dom9_set_membership", with_("host_facts") + "SELECT host, free_mail, abused_tld, shortener FROM host_facts")
def dom9(spark, d):
    return _dim(spark, d).select("host", "free_mail", "abused_tld", "shortener")


@query("dom10_local_domain_intel", with_("host_facts", "lookalike") + f"""
SELECT h.host, h.registrable, h.uhost AS unicode_host, h.public_suffix, h.brand AS official_brand, h.free_mail, h.shortener, h.abused_tld,
  l.like_brand AS lookalike_brand, l.technique, h.mixed_script, CASE WHEN h.is_idn THEN {skel('h.uhost')} END AS idn_skeleton
FROM host_facts h LEFT JOIN lookalike l USING (host)""")
def dom10(spark, d):
    return _dim(spark, d).selectExpr(
        "host", "registrable", "unicode_host", "public_suffix", "brand AS official_brand", "free_mail", "shortener", "abused_tld",
        "lookalike.brand AS lookalike_brand", "lookalike.technique AS technique", "mixed_script", "idn_skeleton")


@query("dom11_host_entropy", f"""
WITH h AS (SELECT DISTINCT {PAGE_HOST} AS host FROM pages),
c AS (SELECT host, ch, count(*) AS n FROM (SELECT host, unnest(string_split(split_part(host, '.', 1), '')) AS ch FROM h) GROUP BY host, ch)
SELECT host, round(0.0 - sum(n / length(split_part(host, '.', 1)) * log2(n / length(split_part(host, '.', 1)))), 6)::DOUBLE AS entropy FROM c GROUP BY host""")
def dom11(spark, d):
    hosts = U.parse(fx.table(spark, d, "pages").select("url")).select("host").distinct().selectExpr("host", "substring_index(host, '.', 1) AS l")
    return hosts.selectExpr("host", f"round({X.entropy_bits('l')}, 6) AS entropy")


# ------------------------------------------------------------------ URLs
@query("url1_url_extract", with_("messages") + f"""
SELECT msg_id, regexp_replace(u, '[.,;:!?)\\]}}>''"]+$', '') AS url FROM (SELECT msg_id, unnest(regexp_extract_all(body, {s(D.URL_IN_TEXT)})) AS u FROM (
  SELECT m.msg_id, m.text||coalesce(' see '||p.url||', or ('||p.url||').', '') AS body FROM messages m LEFT JOIN pages p
    ON p.page_id = m.msg_id % (SELECT max(page_id) + 1 FROM pages)))""")
def url1(spark, d):
    """Links in the plain text of every message; pages, in turn, supply the addresses that the documents lack."""
    pages = fx.table(spark, d, "pages").selectExpr("page_id", "url AS page_url")
    n = pages.agg((F.max("page_id") + 1).alias("n")).scalar()
    body = fx.messages(spark, d).select("msg_id", "text").withColumn("page_id", F.col("msg_id") % n).join(pages, "page_id", "left").selectExpr(
        "msg_id", "concat(text, coalesce(concat(' see ', page_url, ', or (', page_url, ').'), '')) AS text")
    return U.extract_from_text(body).select("msg_id", "url")


@query("url1_page_links", r"""
SELECT page_id, count(*)::BIGINT AS anchors, count(DISTINCT href)::BIGINT AS distinct_targets FROM (
  SELECT page_id, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS a FROM pages)) GROUP BY page_id""")
def url1_pages(spark, d):
    from ..functions.html import anchor_array
    a = fx.table(spark, d, "pages").selectExpr("page_id", f"inline({anchor_array('html')})")
    return a.groupBy("page_id").agg(F.count("*").alias("anchors"), F.count_distinct("href").alias("distinct_targets"))


@query("url2_url_dedup", with_("links0") + """
SELECT msg_id, url, m.s AS source, row_number() OVER (PARTITION BY msg_id ORDER BY m.r, m.p)::BIGINT AS n FROM links0""")
def url2(spark, d):
    return links.dedup(fx.message_links(spark, d)).selectExpr(
        "msg_id", "url", "source", "row_number() OVER (PARTITION BY msg_id ORDER BY src_rank, pos) AS n")


@query("url3_url_parts", with_("links1") + "SELECT msg_id, url, authority, host, port, path, query, executable FROM links1")
def url3(spark, d):
    return U.parse(links.dedup(fx.message_links(spark, d))).select("msg_id", "url", "authority", "host", "port", "path", "query", "executable")


@query("url3_page_parts", r"""
SELECT page_id, lower(regexp_extract(url, '(?i)^https?://([^/?#:]+)', 1)) AS host, regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages""")
def url3_pages(spark, d):
    return U.parse(fx.table(spark, d, "pages").select("page_id", "url")).select("page_id", "host", "path", "query")


INDICATOR_QUERIES = {
    "url4_ind_userinfo": ["userinfo"], "url5_ind_ip": ["obfuscated_ip", "ip_host"], "url6_ind_shortener": ["shortener"],
    "url7_ind_tld": ["suspicious_tld"], "url8_ind_idn": ["idn"], "url9_ind_lookalike": ["lookalike"],
    "url10_ind_shape": ["deep_subdomains", "long_url", "encoded", "port"],
    "url11_ind_credential_path": ["credential_path", "insecure_credential"], "url12_ind_redirect": ["redirect"],
    "url13_ind_download": ["download"], "url14_ind_anchor_mismatch": ["anchor_mismatch"], "url15_ind_scheme": ["dangerous_scheme"],
}


def _register(name, ids):
    @query(name, with_("inds") + f"SELECT msg_id, url, id AS indicator, severity FROM inds WHERE {one_of('id', ids)}")
    def run(spark, d):
        hit = _analysed(spark, d).selectExpr("msg_id", "url", "inline(indicators)")
        return hit.where(among("id", ids)).selectExpr("msg_id", "url", "id AS indicator", "severity")


for _name, _ids in INDICATOR_QUERIES.items():
    _register(_name, _ids)


@query("url16_max_severity", with_("link_risk") + """
SELECT msg_id, url, (['none','info','low','medium','high','critical'])[risk_rank + 1] AS risk, coalesce(indicator_ids, '') AS indicators FROM link_risk""")
def url16(spark, d):
    return _analysed(spark, d).selectExpr("msg_id", "url", f"{U.name_of('risk_rank')} AS risk",
                                          "array_join(transform(indicators, i -> i.id), ',') AS indicators")


@query("url_page_indicators", f"""
WITH p AS (SELECT page_id, url, {PAGE_HOST} AS host, regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM pages)
SELECT page_id, regexp_matches(path, {s(D.DOWNLOAD_EXT)}) AS download, regexp_matches(path||query, {s(D.CREDENTIAL_PATH)}) AS credential_path,
  length(url) > 200 AS long_url FROM p""")
def url_pages(spark, d):
    """Indicator tests over crawled addresses."""
    p = fx.table(spark, d, "pages").selectExpr("page_id AS msg_id", "'text' AS source", "url", "CAST(NULL AS string) AS anchor_text")
    return links.analyse(p).selectExpr(
        "msg_id AS page_id", "exists(indicators, i -> i.id = 'download') AS download",
        "exists(indicators, i -> i.id = 'credential_path') AS credential_path", "exists(indicators, i -> i.id = 'long_url') AS long_url")


@query("url_agg_url_indicator_rollup", with_("url_findings") + """
SELECT msg_id, detector, severity, confidence, title, array_to_string(evidence, ' ; ') AS evidence FROM url_findings""")
def url_agg(spark, d):
    from ..functions.sqltext import array_of
    per = links.with_matches(links.per_message(_analysed(spark, d)))
    rules = array_of(*[links.url_finding(x) for x in D.URL_DETECTORS])
    return per.selectExpr("msg_id", f"inline({rules})").selectExpr(
        "msg_id", "detector", "severity", "confidence", "title", "array_join(evidence, ' ; ') AS evidence")
