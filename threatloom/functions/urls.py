"""URL expressions: parts as written, numeric hosts, indicators."""

from pyspark.sql import DataFrame

from .. import dimensions as D
from .hosts import IPV4, clean_host, is_ip, is_ipv4, registrable
from .sqltext import array_of, one_of, pick, q

NAMES = ["none", "info", "low", "medium", "high", "critical"]
RANK = {n: i for i, n in enumerate(NAMES)}


def rank_of(severity: str) -> str:
    return pick([(f"{severity} = '{n}'", str(r)) for n, r in RANK.items() if r], "0")


def name_of(rank: str) -> str:
    return f"element_at(array({', '.join(q(n) for n in NAMES)}), coalesce({rank}, 0) + 1)"


def full_url(url: str) -> str:
    return f"IF({url} RLIKE {q('^(?i)www' + chr(92) + '.')}, concat('http://', {url}), {url})"


def written_host(authority: str) -> str:
    """Host part of an authority: after the last '@', without port or brackets, lower case."""
    hp = f"regexp_replace({authority}, '^.*@', '')"
    return (f"lower(IF(startswith({hp}, '['), regexp_extract({hp}, {q(r'^' + chr(92) + '[([^' + chr(92) + ']]*)' + chr(92) + ']')}, 1), "
            f"regexp_extract({hp}, '^([^:]*)', 1)))")


OBFUSCATED = [r"^[0-9]{8,10}$", r"^(?i)0x[0-9a-f]{6,8}$"]
OBFUSCATED_PARTS = r"^(?i)(?:0x[0-9a-f]+|0[0-9]+|[0-9]+)(?:\.(?:0x[0-9a-f]+|0[0-9]+|[0-9]+)){1,3}$"


def obfuscated_ip(host: str) -> str:
    return (f"({host} RLIKE {q(OBFUSCATED[0])} OR {host} RLIKE {q(OBFUSCATED[1])} OR "
            f"({host} RLIKE {q(OBFUSCATED_PARTS)} AND NOT {host} RLIKE {q(IPV4)}))")


def numeric_host(host: str) -> str:
    """Dotted form of a decimal, hex or octal IPv4 host, or null when the host is not numeric."""
    number = ("try_cast(CASE WHEN p RLIKE '^(?i)0x[0-9a-f]+$' THEN conv(substring(p, 3, 20), 16, 10) "
              "WHEN p RLIKE '^0[0-7]+$' THEN conv(p, 8, 10) WHEN p RLIKE '^[0-9]+$' THEN p END AS bigint)")
    parts = f"transform(split({host}, {q(chr(92) + '.')}), p -> {number})"
    n = f"size({parts})"
    lead = (f"aggregate(IF({n} > 1, slice({parts}, 1, greatest({n} - 1, 1)), CAST(array() AS array<bigint>)), 0L, "
            "(a, x) -> a * 256 + x)")
    value = (f"({lead} * CASE {n} WHEN 1 THEN 4294967296 WHEN 2 THEN 16777216 WHEN 3 THEN 65536 ELSE 256 END "
             f"+ try_element_at({parts}, -1))")
    ok = f"{n} <= 4 AND forall({parts}, x -> x IS NOT NULL) AND {value} BETWEEN 0 AND 4294967295"
    dotted = ", ".join(f"string(({value} DIV {d}) % 256)" for d in (16777216, 65536, 256, 1))
    return f"CASE WHEN {host} RLIKE '^(?i)[0-9a-fx.]+$' AND {host} RLIKE '[0-9]$|0x[0-9a-f]*$' AND {ok} THEN concat_ws('.', {dotted}) END"


def parse(links: DataFrame) -> DataFrame:
    """Add the parts of ``url``; rows that are neither web links nor executable links are dropped."""
    scheme = "lower(regexp_extract(url, '^(?i)([a-z][a-z0-9+.-]*):', 1))"
    df = links.selectExpr("*", f"{scheme} AS scheme", f"{full_url('url')} AS _full",
                          "regexp_extract(url, '^(?i)[a-z]+://([^/?#]*)', 1) AS authority")
    df = df.selectExpr(
        "*", "scheme IN ('javascript', 'vbscript') OR (scheme = 'data' AND url RLIKE '^(?i)data:text/html') AS executable",
        "regexp_extract(_full, '^(?i)https?://([^/?#]*)', 1) AS _auth",
        "regexp_extract(_full, '^(?i)https?://[^/?#]*([^?#]*)', 1) AS path",
        f"regexp_extract(_full, {q('^[^?#]*' + chr(92) + '?([^#]*)')}, 1) AS query")
    decoded = f"lower(coalesce(try_url_decode(replace({written_host('_auth')}, '+', '%2B')), {written_host('_auth')}))"
    df = df.selectExpr("*", f"{decoded} AS _host", "regexp_extract(_auth, ':([0-9]+)$', 1) AS port")
    bad = r"[\s<>^|%\\\[\]]"
    df = df.where(f"executable OR (_full RLIKE '^(?i)https?://' AND _host <> '' AND NOT _host RLIKE {q(bad)} "
                  "AND (port = '' OR coalesce(try_cast(port AS int) <= 65535, false)))")
    numeric = f"IF({is_ipv4('_host')}, NULL, {numeric_host('_host')})"
    host = f"IF(executable, '', {clean_host(f'coalesce({numeric}, _host)')})"
    return df.selectExpr(*links.columns, "scheme", "executable", "authority", f"{host} AS host", "port", "path", "query")


def shown_domain(anchor: str) -> str:
    return f"nullif(regexp_extract({anchor}, {q(D.DOMAIN_IN_TEXT)}, 1), '')"


def foreign_redirect(query: str, own: str) -> str:
    """True when a redirect-style parameter carries a URL on another registrable domain."""
    value = "coalesce(try_url_decode(regexp_replace(p, '^[^=]*=?', '')), '')"
    target = f"lower(regexp_extract({value}, '^(?i)(?:https?:)?//(?:[^/?#]*@)?([^/?#:]+)', 1))"
    names = one_of("lower(substring_index(p, '=', 1))", D.REDIRECT_PARAMS)
    hosts = f"filter(transform(filter(split({query}, '&'), p -> {names}), p -> {target}), t -> t <> '')"
    return f"exists({hosts}, t -> {registrable('t')} <> {own})"


def with_indicators(links: DataFrame) -> DataFrame:
    """Add indicators array<struct<id, severity>> in test order to parsed links joined to host rows (prefix h_)."""
    written = "regexp_extract(regexp_replace(authority, '^.*@', ''), '^([^:]*)', 1)"
    df = links.selectExpr(
        "*", "NOT executable AS _web", f"{obfuscated_ip(written)} AS _hidden_ip",
        "coalesce(try_url_decode(replace(path, '+', '%2B')), path) AS _path",
        "IF(query <> '', concat('?', query), '') AS _search", f"lower({shown_domain('anchor_text')}) AS _shown")
    df = df.selectExpr("*", f"{registrable('_shown')} AS _shown_org", f"_path RLIKE {q(D.CREDENTIAL_PATH)} AS _cpath")

    def test(cond, name, severity):
        sev = severity if severity.startswith("IF(") else q(severity)
        return f"CASE WHEN _web AND {cond} THEN named_struct('id', '{name}', 'severity', {sev}) END"

    esc = q("(?i)%[0-9a-f]{2}")
    tests = [
        "CASE WHEN executable THEN named_struct('id', 'dangerous_scheme', 'severity', 'high') END",
        test("contains(authority, '@')", "userinfo", "high"),
        test("_hidden_ip", "obfuscated_ip", "high"),
        test(f"NOT _hidden_ip AND {is_ip('host')}", "ip_host", "high"),
        test("h_shortener", "shortener", "medium"),
        test("h_abused_tld", "suspicious_tld", "medium"),
        test("h_is_idn", "idn", "IF(h_mixed_script, 'critical', 'medium')"),
        test("h_lookalike IS NOT NULL", "lookalike", "IF(h_lookalike.confidence >= 0.9D, 'critical', 'high')"),
        test("h_sub_levels >= 4", "deep_subdomains", "low"),
        test("length(url) > 200", "long_url", "low"),
        test(f"(authority RLIKE {esc} OR regexp_count(url, {esc}) > 12)", "encoded", "medium"),
        test("port <> '' AND port NOT IN ('80', '443')", "port", "low"),
        test(f"h_brand IS NULL AND (_cpath OR concat(_path, _search) RLIKE {q(D.CREDENTIAL_PATH)})", "credential_path",
             "medium"),
        test(f"h_brand IS NULL AND url RLIKE {q('^(?i)(?:http:|www' + chr(92) + '.)')} AND _cpath", "insecure_credential", "low"),
        test(foreign_redirect("query", "h_registrable"), "redirect", "IF(h_brand IS NULL, 'low', 'medium')"),
        test(f"path RLIKE {q(D.DOWNLOAD_EXT)}", "download", "medium"),
        test("source = 'anchor' AND contains(_shown_org, '.') AND _shown_org <> h_registrable", "anchor_mismatch", "high"),
    ]
    df = df.selectExpr("*", f"{array_of(*tests)} AS indicators")
    df = df.drop("_web", "_hidden_ip", "_path", "_search", "_shown", "_shown_org", "_cpath")
    return df.selectExpr("*", f"{worst('indicators')} AS risk_rank")


def worst(inds: str) -> str:
    return f"coalesce(array_max(transform({inds}, i -> {rank_of('i.severity')})), 0)"


def extract_from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Links in plain text: msg_id, pos, source, url."""
    tail = q(r"""[.,;:!?)\]}>'"]+$""")
    found = f"transform(regexp_extract_all({text}, {q(D.URL_IN_TEXT)}, 0), x -> regexp_replace(x, {tail}, ''))"
    return df.selectExpr("msg_id", f"posexplode({found}) AS (pos, url)").selectExpr("msg_id", "pos", "'text' AS source", "url")
