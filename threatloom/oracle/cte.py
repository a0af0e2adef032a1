"""Independent DuckDB formulation of the engine, as named WITH items with their dependencies."""

from .. import dimensions as D
from .. import fixtures as fx


def s(v):
    return "'" + str(v).replace("'", "''") + "'"


def one_of(e, vals):
    return f"{e} IN ({', '.join(s(v) for v in vals)})"


def up(e, d=2):
    m = 10 ** d
    return f"(floor(({e})*{m}+0.5)/{m})"


def steady_up(e, d=2):
    m = 10 ** d
    return f"(floor(round(({e})*{m}, 6)+0.5)/{m})"


def last(h, n):
    return f"array_to_string(string_split({h}, '.')[-{n}:], '.')"


IPV4 = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def is_ip(h):
    return f"(regexp_matches({h}, {s(IPV4)}) OR (contains({h}, ':') AND regexp_matches({h}, '^[0-9a-f:.]+$')))"


def org(h):
    return f"CASE WHEN {is_ip(h)} THEN {h} WHEN {one_of(last(h, 2), D.MULTI_LABEL_SUFFIXES)} THEN {last(h, 3)} ELSE {last(h, 2)} END"


def suffix(h):
    return f"CASE WHEN {is_ip(h)} THEN '' WHEN {one_of(last(h, 2), D.MULTI_LABEL_SUFFIXES)} THEN {last(h, 2)} ELSE {last(h, 1)} END"


def leet(x):
    for a, b in D.SUBSTITUTIONS:
        x = f"replace({x}, {s(a)}, {s(b)})"
    return x


def skel(x):
    return f"translate(lower({x}), {s(''.join(D.CONFUSABLES))}, {s(''.join(D.CONFUSABLES.values()))})"


def ifel(c, a, b="NULL"):
    return f"CASE WHEN {c} THEN {a} ELSE {b} END"


CTE = {}


def add(name, sql, *deps):
    CTE[name] = (deps, sql if sql.lstrip().startswith(("dim_", name)) else f"{name} AS ({sql})")


def with_(*names):
    """WITH list holding the named items and everything they need."""
    done, out = set(), []

    def visit(n):
        if n in done:
            return
        done.add(n)
        deps, sql = CTE[n]
        for d in deps:
            visit(d)
        out.append(sql)
    for n in names:
        visit(n)
    return "WITH " + ",\n".join(out) + "\n"


add("messages", fx.duck_messages().lstrip())
add("message_links", fx.duck_links())
add("message_files", fx.duck_files())
add("feedback", fx.duck_feedback().lstrip())
add("model_scores", fx.duck_scores().lstrip())
add("scored", fx.duck_labelled_scores().lstrip())
add("dim_reputation", fx.duck_dim("dim_reputation"))
add("dim_keyword", fx.duck_rows("dim_keyword", "brand kw ord", D.brand_keywords()))
add("dim_official", fx.duck_rows("dim_official", "domain brand ord", D.official_domains()))
add("dim_mention", fx.duck_rows("dim_mention", "brand pattern ord", [(b, p, i) for i, (b, p) in enumerate(D.brand_mentions())]))
add("dim_cap", fx.duck_rows("dim_cap", "score_group cap label", [(g, c, D.GROUP_LABELS[g]) for g, c in D.GROUP_CAPS.items()]))
add("dim_sev", fx.duck_rows("dim_sev", "severity rank points", [(v, i, D.SEVERITY_POINTS[v]) for i, v in enumerate(D.SEVERITIES)]))

# ---------------------------------------------------------------- headers
add("headers", r"""
  SELECT msg_id, pos, regexp_extract(line, '^([^:]*):', 1) AS name, trim(regexp_replace(line, '^[^:]*:[ \t]*', '')) AS value
  FROM (SELECT msg_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (
    SELECT msg_id, string_split_regex(regexp_replace(header_block, '[ \t]*\r?\n[ \t]+', ' ', 'g'), '\r?\n') AS l FROM messages))
  WHERE regexp_matches(line, '^[!-9;-~]+:')""", "messages")


def hv(name, agg="min_by(value, pos)"):
    return f"{agg} FILTER (WHERE lower(name) = '{name}')"


add("hfirst", f"""
  SELECT msg_id, {hv('from')} AS v_from, count(*) FILTER (WHERE lower(name)='from') AS from_count,
    {hv('reply-to')} AS v_reply, {hv('return-path')} AS v_return, {hv('message-id')} AS message_id,
    coalesce({hv('x-mailer')}, {hv('user-agent')}) AS mailer, {hv('date')} AS v_date,
    {hv('authentication-results')} AS v_auth, count(*) FILTER (WHERE lower(name)='authentication-results') AS auth_headers,
    {hv('received-spf')} AS v_spf, count(*) FILTER (WHERE lower(name)='dkim-signature') AS n_dkim
  FROM headers GROUP BY msg_id""", "headers")
add("sender", f"""
  SELECT *, {org('from_domain')} AS from_org, {org('reply_domain')} AS reply_org, {org('return_domain')} AS return_org FROM (
  SELECT h.*, trim(regexp_replace(trim(regexp_replace(v_from, '<[^<>]*>.*$', '')), '^"|"$', '', 'g')) AS from_name,
    lower(regexp_extract(v_from, '<([^<>]*)>', 1)) AS from_address,
    lower(split_part(regexp_extract(v_from, '<([^<>]*)>', 1), '@', 2)) AS from_domain,
    lower(v_reply) AS reply_address, coalesce(lower(split_part(v_reply, '@', 2)), '') AS reply_domain,
    lower(regexp_extract(v_return, '<([^>]*)>', 1)) AS return_path,
    coalesce(lower(split_part(regexp_extract(v_return, '<([^>]*)>', 1), '@', 2)), '') AS return_domain
  FROM hfirst h)""", "hfirst")

def date_utc(e):
    plain = f"trim(regexp_replace(regexp_replace({e}, '\\([^)]*\\)', '', 'g'), '^\\s*[A-Za-z]+,', ''))"
    base = f"try_strptime(regexp_replace({plain}, ' [+-][0-9]{{4}}$', ''), '%d %b %Y %H:%M:%S')"
    off = f"TRY_CAST(regexp_extract({plain}, ' ([+-][0-9]{{2}})[0-9]{{2}}$', 1) AS INTEGER)"
    return f"({base} - to_hours(coalesce({off}, 0)))"


add("hops", f"""
  SELECT *, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY msg_id ORDER BY hop) AS delay_seconds FROM (
  SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY pos DESC) AS hop, value,
    nullif(trim(regexp_extract(value, '(?i)\\bfrom\\s+(.+?)(\\s+by\\s|\\s+with\\s|\\s+id\\s|\\s+for\\s|;|$)', 1)), '') AS sender,
    nullif(regexp_extract(value, '(?i)\\bby\\s+([^\\s;()]+)', 1), '') AS by_host,
    nullif(regexp_extract(value, '(?i)\\bwith\\s+([^\\s;()]+)', 1), '') AS with_proto,
    CASE WHEN contains(value, ';') THEN {date_utc("regexp_extract(value, ';([^;]*)$', 1)")} END AS ts
  FROM headers WHERE lower(name) = 'received')""", "headers")
add("hopflags", """
  SELECT *, sender IS NOT NULL AND regexp_matches(sender, '(?i)\\bunknown\\b') AND from_ip IS NOT NULL
      AND NOT regexp_matches(from_ip, '^(10|127|192\\.168|169\\.254|172\\.(1[6-9]|2[0-9]|3[01]))\\.') AS no_rdns,
    ts IS NULL AS no_time, coalesce(delay_seconds < -300, false) AS backwards, coalesce(delay_seconds > 86400, false) AS late
  FROM (SELECT *, nullif(regexp_extract(sender, '\\[([0-9.]+)\\]', 1), '') AS from_ip FROM hops)""", "hops")
add("routing", """
  SELECT msg_id, bool_or(backwards) AS backwards, bool_or(no_rdns) AS no_rdns, min_by(ts, hop) FILTER (WHERE hop=1) AS origin_ts,
    max(from_ip) FILTER (WHERE hop = 1) AS origin_ip FROM hopflags GROUP BY msg_id""", "hopflags")


def meth(m):
    return f"nullif(lower(regexp_extract(st, '(?i)[;\\s]{m}=([^\\s;]+)', 1)), '')"


def prop(m, p):
    tail = f"regexp_extract(st, '(?i)[;\\s]{m}=[^\\s;]+([^;]*)', 1)"
    return f"nullif(lower(regexp_extract({tail}, '(?i)\\s{p.replace('.', '[.]')}=([^\\s]+)', 1)), '')"


def state(e):
    return (f"CASE WHEN {e} IS NULL THEN 'not_present' WHEN {e}='pass' THEN 'pass' WHEN {e} IN "
            "('fail','softfail','hardfail','permerror') THEN 'fail' ELSE 'unknown' END")


add("auth", f"""
  SELECT msg_id, auth_headers, from_domain, spf_result, spf_domain, {state('spf_result')} AS spf_state, dkim_result, dkim_domain,
    CASE WHEN dkim_result IS NULL AND n_dkim > 0 THEN 'unknown' ELSE {state('dkim_result')} END AS dkim_state,
    dmarc_result, dmarc_domain, {state('dmarc_result')} AS dmarc_state,
    {org('dmarc_domain')} = from_org AS dmarc_aligned, {org('dkim_domain')} = from_org AS dkim_aligned,
    {org('spf_domain')} = from_org AS spf_aligned FROM (
  SELECT *, CASE WHEN {meth('spf')} IS NULL AND v_spf IS NOT NULL THEN lower(regexp_extract(v_spf, '^\\s*([A-Za-z0-9_]+)', 1))
      ELSE {meth('spf')} END AS spf_result,
    regexp_replace(CASE WHEN {meth('spf')} IS NULL AND v_spf IS NOT NULL
      THEN nullif(regexp_extract(v_spf, '(?i)envelope-from=<?([^>;\\s]+)', 1), '')
      ELSE coalesce({prop('spf', 'smtp.mailfrom')}, {prop('spf', 'smtp.helo')}) END, '^.*@', '') AS spf_domain,
    {meth('dkim')} AS dkim_result,
    coalesce({prop('dkim', 'header.d')}, regexp_replace({prop('dkim', 'header.i')}, '^.*@', '')) AS dkim_domain,
    {meth('dmarc')} AS dmarc_result, coalesce({prop('dmarc', 'header.from')}, from_domain) AS dmarc_domain
  FROM (SELECT *, CASE WHEN regexp_matches(split_part(plain, ';', 1), '(spf|dkim|dmarc)\\s*=') THEN ';'||plain
      ELSE regexp_replace(plain, '^[^;]*', '') END AS st
    FROM (SELECT *, regexp_replace(v_auth, '\\([^()]*\\)', ' ', 'g') AS plain FROM sender)))""", "sender")

# ---------------------------------------------------------------- hosts
add("links0", """
  SELECT msg_id, url, min(struct_pack(r := CASE source WHEN 'anchor' THEN 0 WHEN 'form' THEN 1 WHEN 'text' THEN 2 ELSE 3 END,
      p := pos, s := source, a := anchor_text)) AS m
  FROM message_links WHERE NOT regexp_matches(url, '(?i)^(mailto|tel|cid|#)') GROUP BY msg_id, url, source = 'image'""",
    "message_links")
add("links1", r"""
  SELECT *, regexp_extract(full_url, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(full_url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(hp, ':([0-9]+)$', 1) AS port,
    CASE WHEN executable THEN '' WHEN regexp_matches(split_part(hp, ':', 1), '^[0-9]{8,10}$') THEN
      (split_part(hp, ':', 1)::BIGINT // 16777216) ||'.'|| (split_part(hp, ':', 1)::BIGINT // 65536 % 256) ||'.'||
      (split_part(hp, ':', 1)::BIGINT // 256 % 256) ||'.'|| (split_part(hp, ':', 1)::BIGINT % 256)
      ELSE lower(url_decode(split_part(hp, ':', 1))) END AS host
  FROM (SELECT *, regexp_replace(regexp_extract(full_url, '(?i)^https?://([^/?#]*)', 1), '^.*@', '') AS hp
    FROM (SELECT msg_id, url, m.r AS src_rank, m.p AS pos, m.s AS source, m.a AS anchor_text,
        regexp_matches(url, '(?i)^(javascript|vbscript):|^data:text/html') AS executable,
        CASE WHEN regexp_matches(url, '(?i)^www\.') THEN 'http://'||url ELSE url END AS full_url,
        regexp_extract(url, '(?i)^[a-z]+://([^/?#]*)', 1) AS authority FROM links0))""", "links0")
# Unicode forms of the corpus' internationalised hosts; DuckDB has no punycode decoder.
add("dim_idn", fx.duck_rows("dim_idn", "ascii_host unicode_host", [("xn--pple-43d.com", "аpple.com")]))
add("all_hosts", "SELECT host FROM links1 WHERE host <> '' UNION SELECT from_domain FROM sender", "links1", "sender")
add("hostx", f"""
  SELECT *, array_to_string(string_split(uhost, '.')[-2:][:1], '.') AS ulabel0,
    CASE WHEN isip THEN host ELSE string_split(registrable, '.')[1] END AS label,
    CASE WHEN length(host) > length(registrable) THEN substring(host, 1, length(host)-length(registrable)-1) ELSE '' END AS subdomain
  FROM (SELECT host, coalesce(unicode_host, host) AS uhost, {is_ip('host')} AS isip,
      regexp_matches(host, '(^|\\.)xn--') OR regexp_matches(host, '[^ -~]') AS is_idn,
      {org('host')} AS registrable, {suffix('host')} AS public_suffix
    FROM all_hosts LEFT JOIN dim_idn ON host = ascii_host)""", "all_hosts", "dim_idn")
add("host_facts", f"""
  SELECT h.*, o.brand, CASE WHEN is_idn THEN ulabel0 ELSE label END AS ulabel, {last('public_suffix', 1)} AS tld,
    {one_of('registrable', D.FREE_MAIL)} AS free_mail, {one_of(last('public_suffix', 1), D.ABUSED_TLDS)} AS abused_tld,
    {one_of('registrable', D.SHORTENERS)} OR {one_of('host', D.SHORTENERS)} AS shortener,
    CASE WHEN subdomain = '' THEN 0 ELSE len(string_split(subdomain, '.')) END AS sub_levels,
    is_idn AND len(list_filter(string_split(uhost, '.'), lambda x: regexp_matches(x, '\\p{{Latin}}') AND
      regexp_matches(x, '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}]'))) > 0 AS mixed_script
  FROM hostx h LEFT JOIN dim_official o ON o.domain = h.registrable""", "hostx", "dim_official")
C = D.LOOKALIKE_CONFIDENCE
add("pairs", f"""
  SELECT h.host, h.label, h.ulabel, k.brand, k.kw, k.ord, length(k.kw) AS n, {skel('h.ulabel')} AS us, {leet(skel('h.ulabel'))} AS fs,
    levenshtein(h.label, k.kw) AS d, list_filter(string_split_regex(h.label, '[-_]'), lambda t: t <> '') AS toks,
    string_split_regex(h.subdomain, '[._-]') AS subs
  FROM host_facts h CROSS JOIN dim_keyword k WHERE NOT h.isip AND h.label <> '' AND h.brand IS DISTINCT FROM k.brand""",
    "host_facts", "dim_keyword")
TOK = "list_filter(toks, lambda t: {0})"
add("pair_conf", f"""
  SELECT *, CASE
    WHEN regexp_matches(ulabel, '[^ -~]') AND us = kw THEN {C['homoglyph']}
    WHEN label <> kw AND fs = kw THEN {C['substitution']}
    WHEN n >= 5 AND length(label) >= 5 AND d = 1 THEN {C['one_edit']}
    WHEN n >= 8 AND length(label) >= 5 AND d = 2 THEN {C['two_edits']}
    WHEN len(toks) > 1 AND n >= 5 AND len({TOK.format(f"t <> kw AND {leet(skel('t'))} = kw")}) > 0 THEN {C['token_skeleton']}
    WHEN len(toks) > 1 AND list_contains(toks, kw) THEN {C['token_equal']}
    WHEN list_contains(subs, kw) THEN {C['subdomain']}
    WHEN len(toks) > 1 AND n >= 6 AND len({TOK.format(f"length(t) >= 6 AND {leet(skel('t'))} <> kw AND levenshtein(t, kw) = 1")}) > 0 THEN {C['token_one_edit']}
    WHEN len(toks) = 1 AND n >= 5 AND length(label) > n + 2 AND contains(label, kw) THEN {C['contains']} END AS conf
  FROM pairs""", "pairs")
add("lookalike", """
  SELECT host, brand AS like_brand, kw, conf::DOUBLE AS conf, CASE
    WHEN regexp_matches(ulabel, '[^ -~]') AND us = kw THEN 'homoglyph' WHEN label <> kw AND fs = kw THEN 'character_substitution'
    WHEN conf IN (0.88, 0.75) OR (conf = 0.80 AND n >= 8 AND d = 2) THEN 'typosquat' WHEN conf = 0.93 THEN 'character_substitution'
    WHEN conf = 0.80 THEN 'brand_in_subdomain' ELSE 'brand_embedded' END AS technique
  FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY conf DESC, ord) AS rn FROM pair_conf WHERE conf IS NOT NULL)
  WHERE rn = 1""", "pair_conf")

# ---------------------------------------------------------------- URL indicators
CP = D.CREDENTIAL_PATH
add("links2", f"""
  SELECT l.*, h.registrable, h.brand, h.mixed_script, h.is_idn, h.sub_levels, h.abused_tld, h.shortener, h.isip, k.conf,
    regexp_replace(split_part(regexp_replace(authority, '^.*@', ''), ':', 1), '', '') AS written,
    url_decode(path) AS dpath, CASE WHEN query <> '' THEN '?'||query ELSE '' END AS search,
    lower(nullif(regexp_extract(anchor_text, {s(D.DOMAIN_IN_TEXT)}, 1), '')) AS shown
  FROM links1 l LEFT JOIN host_facts h USING (host) LEFT JOIN lookalike k USING (host)""", "links1", "host_facts", "lookalike")
HID = r"regexp_matches(written, '^[0-9]{8,10}$')"
TESTS = [
    ("dangerous_scheme", "executable", "'high'"), ("userinfo", "contains(authority, '@')", "'high'"),
    ("obfuscated_ip", HID, "'high'"), ("ip_host", f"NOT {HID} AND coalesce(isip, false)", "'high'"),
    ("shortener", "coalesce(shortener, false)", "'medium'"), ("suspicious_tld", "coalesce(abused_tld, false)", "'medium'"),
    ("idn", "coalesce(is_idn, false)", ifel("mixed_script", "'critical'", "'medium'")),
    ("lookalike", "conf IS NOT NULL", ifel("conf >= 0.9", "'critical'", "'high'")),
    ("deep_subdomains", "coalesce(sub_levels >= 4, false)", "'low'"), ("long_url", "length(url) > 200", "'low'"),
    ("encoded", "regexp_matches(authority, '(?i)%[0-9a-f]{2}') OR len(regexp_extract_all(url, '(?i)%[0-9a-f]{2}')) > 12", "'medium'"),
    ("port", "port <> '' AND port NOT IN ('80', '443')", "'low'"),
    ("credential_path", f"NOT executable AND brand IS NULL AND regexp_matches(dpath||search, {s(CP)})", "'medium'"),
    ("insecure_credential", f"brand IS NULL AND regexp_matches(url, '(?i)^http:') AND regexp_matches(dpath, {s(CP)})", "'low'"),
    ("redirect", f"""len(list_filter(string_split(query, '&'), lambda p: {one_of("lower(split_part(p, '=', 1))", D.REDIRECT_PARAMS)}
        AND regexp_matches(url_decode(regexp_replace(p, '^[^=]*=', '')), '(?i)^(https?:)?//')
        AND ({org("regexp_extract(url_decode(regexp_replace(p, '^[^=]*=', '')), '//([^/?#:]+)', 1)")}) <> registrable)) > 0""",
     ifel("brand IS NOT NULL", "'medium'", "'low'")),
    ("download", f"regexp_matches(path, {s(D.DOWNLOAD_EXT)})", "'medium'"),
    ("anchor_mismatch", f"NOT executable AND source = 'anchor' AND shown IS NOT NULL AND ({org('shown')}) <> registrable", "'high'"),
]
RANK = "CASE {0} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
NAME = "(['info','low','medium','high','critical'])[{0}]"
add("inds", "\n UNION ALL ".join(
    f"SELECT msg_id, url, source, host, registrable, src_rank, pos, {i} AS ord, '{n}' AS id, {sev} AS severity FROM links2 WHERE {cond}"
    for i, (n, cond, sev) in enumerate(TESTS)), "links2")
add("link_risk", f"""
  SELECT l.msg_id, l.url, l.source, l.src_rank, l.pos, l.host, coalesce(l.registrable, '') AS registrable, l.brand,
    coalesce(l.mixed_script, false) AS mixed_script, l.anchor_text,
    coalesce(max({RANK.format('i.severity')}), 0) AS risk_rank, string_agg(i.id, ',' ORDER BY i.ord) AS indicator_ids
  FROM links2 l LEFT JOIN inds i ON l.msg_id = i.msg_id AND l.url = i.url AND l.source = i.source GROUP BY ALL""", "links2", "inds")

# ---------------------------------------------------------------- files
E = lambda c, v: one_of(c, v)
add("files1", """
  SELECT msg_id, pos, filename AS raw_name, regexp_extract(filename, '([^\\\\/]*)$', 1) AS filename, content_hex, declared_type,
    octet_length(content) AS size, sha256(content) AS sha256, md5(content) AS md5,
    CASE WHEN content_hex LIKE '4D5A%' THEN 'application/x-msdownload (PE executable)'
         WHEN content_hex LIKE '504B0304%' THEN 'application/zip (or OOXML)' END AS detected_type,
    list_filter(string_split(lower(regexp_extract(filename, '([^\\\\/]*)$', 1)), '.')[2:], lambda x: regexp_matches(x, '^[a-z0-9]{1,8}$')) AS chain
  FROM message_files""", "message_files")
FT = [("executable", E("ext", D.EXT_EXECUTABLE), "critical"), ("disk_image", E("ext", D.EXT_CONTAINER), "high"),
      ("macro", E("ext", D.EXT_MACRO), "high"), ("html_attachment", E("ext", D.EXT_MARKUP), "high"),
      ("double_extension", f"{E('prev', D.EXT_DECOY)} AND NOT {E('ext', D.EXT_DECOY)}", "critical"),
      ("rtlo", "regexp_matches(raw_name, '[‮‭‏]')", "critical"),
      ("type_mismatch", f"detected_type LIKE '%PE executable%' AND NOT {E('ext', D.EXT_EXECUTABLE)}", "critical"),
      ("archive", E("ext", D.EXT_ARCHIVE), "low"),
      ("archive_executable", "detected_type LIKE 'application/zip%'", "critical"), ("empty", "size = 0", "info")]
add("files2", "SELECT *, coalesce(chain[-1], '') AS ext, coalesce(chain[-2], '') AS prev FROM files1", "files1")
add("file_inds", "\n UNION ALL ".join(
    f"SELECT msg_id, pos, filename, sha256, {i} AS ord, '{n}' AS id, '{sv}' AS severity FROM files2 WHERE {c}"
    for i, (n, c, sv) in enumerate(FT)), "files2")
add("file_risk", f"""
  SELECT f.msg_id, f.pos, f.filename, f.ext AS extension, f.size, f.sha256, f.md5, f.detected_type,
    coalesce(max({RANK.format('i.severity')}), 0) AS risk_rank, string_agg(i.id, ',' ORDER BY i.ord) AS indicator_ids
  FROM files2 f LEFT JOIN file_inds i ON f.msg_id = i.msg_id AND f.pos = i.pos GROUP BY ALL""", "files2", "file_inds")

# ---------------------------------------------------------------- phrases
IDS = list(D.INTENTS)


def _phrases():
    body = {i: "text" for i in IDS}
    prev = "messages"
    for lv in range(7):
        live = [i for i in IDS if lv < len(D.INTENTS[i][1])]
        hit = ", ".join(f"regexp_matches({body[i]}, {s('(?i)' + D.INTENTS[i][1][lv][0])}) OR "
                        f"regexp_matches(lower(subject), {s('(?i)' + D.INTENTS[i][1][lv][0])}) AS hit_{i}_{lv}" for i in live)
        mask = ", ".join(f"regexp_replace({body[i]}, {s('(?i)' + D.INTENTS[i][1][lv][0])}, chr(1), 'g') AS t_{i}_{lv}" for i in live)
        old = "" if lv == 0 else ", " + ", ".join(f"hit_{i}_{k}" for k in range(lv) for i in IDS if k < len(D.INTENTS[i][1]))
        add(f"ph{lv}", f"SELECT msg_id, text, subject{old}, {hit}, {mask} FROM {prev}", prev)
        prev = f"ph{lv}"
        body = {i: f"t_{i}_{lv}" for i in IDS}


_phrases()
add("raw_intents", "SELECT msg_id, " + ", ".join(
    " + ".join(f"CASE WHEN hit_{i}_{k} THEN {w} ELSE 0 END::DOUBLE" for k, (_, w) in enumerate(D.INTENTS[i][1])) + f" AS raw_{i}"
    for i in IDS) + " FROM ph6", "ph6")
add("html_counts", """
  SELECT msg_id, len(regexp_extract_all(coalesce(html, ''), '(?i)<script'))::INTEGER AS script_count,
    len(regexp_extract_all(coalesce(html, ''), 'display:none'))::INTEGER AS hidden_count,
    len(regexp_extract_all(coalesce(html, ''), '(?i)<form'))::INTEGER AS form_count,
    CASE WHEN contains(html, 'type="password"') THEN 1 ELSE 0 END AS password_forms FROM messages""", "messages")
add("link_msg", """
  SELECT msg_id, count(*) FILTER (WHERE source <> 'image') > 0 AS has_link, bool_or(risk_rank >= 4) AS risky
  FROM link_risk GROUP BY msg_id""", "link_risk")
ASK = " OR ".join(f"raw_{i} > 0" for i in ("credential_request", "mfa_request", "payment_request", "gift_card", "bank_change"))
HUSH = "(raw_secrecy > 0 OR raw_account_threat > 0 OR raw_urgency > 0)"
add("intents", f"""
  SELECT r.*, cta, {ifel("raw_account_threat > 0", up("c1 * 1.2"), "c1")} AS score_credential_request, raw_mfa_request AS score_mfa_request,
    {ifel(HUSH, up("raw_payment_request * 1.3"), "raw_payment_request")} AS score_payment_request,
    {ifel(HUSH, up("raw_gift_card * 1.2"), "raw_gift_card")} AS score_gift_card,
    {ifel(HUSH, up("raw_bank_change * 1.2"), "raw_bank_change")} AS score_bank_change,
    {ifel(f"NOT ({ASK} OR raw_account_threat > 0)", up("raw_urgency * 0.5"), "raw_urgency")} AS score_urgency,
    {ifel(f"NOT ({ASK} OR raw_secrecy > 0)", up("raw_authority * 0.5"), "raw_authority")} AS score_authority,
    raw_account_threat AS score_account_threat, raw_secrecy AS score_secrecy, raw_prize_lure AS score_prize_lure,
    raw_delivery_lure AS score_delivery_lure, raw_job_lure AS score_job_lure
  FROM (SELECT ri.*, coalesce(lm.has_link, false) OR hc.form_count > 0 AS cta,
      CASE WHEN coalesce(lm.has_link, false) OR hc.form_count > 0 THEN {up('raw_credential_request * 1.3')} ELSE raw_credential_request END AS c1
    FROM raw_intents ri JOIN html_counts hc USING (msg_id) LEFT JOIN link_msg lm USING (msg_id)) r""",
    "raw_intents", "html_counts", "link_msg")


# ---------------------------------------------------------------- findings
def row(ord_, src, det, cat, sev, conf, title, grp, cond):
    q = lambda v: v if v.startswith(("CASE", "'", "(")) else s(v)
    return (f"SELECT msg_id, {ord_} AS ord, {s(det)} AS detector, {s(cat)} AS category, {q(sev)} AS severity, ({conf})::DOUBLE AS confidence, "
            f"{q(title)} AS title, {s(grp)} AS score_group FROM {src} WHERE {cond}")


def sev_case(score, th):
    return "CASE " + " ".join(f"WHEN {score} >= {m} THEN '{v}'" for v, m in th) + " END"


def content_rows():
    out = []
    ords = [200, 201, 202, 203, 204, 206, 207, 208]
    for n, (det, title, ids, th) in enumerate(D.INTENT_RULES):
        sc = "(" + " + ".join(f"score_{i}" for i in ids) + ")"
        t = title
        if det == "content.financial_request":
            t = ("CASE WHEN raw_bank_change > 0 THEN 'Request to pay to changed bank details' WHEN raw_gift_card > 0 THEN "
                 "'Gift card request' ELSE 'Payment request' END")
        out.append(row(ords[n], "intents", det, "content", sev_case(sc, th), f"least(0.95, {up(f'0.5 + {sc}/10')})", t, "content",
                       f"{sc} >= {th[-1][1]}"))
    out.append(row(205, "intents", "content.social_engineering", "content", "high", "0.85", "Pressure + request + action pattern",
                   "content_pattern", f"score_urgency + score_account_threat >= 2 AND ({ASK}) AND (cta OR raw_gift_card > 0 OR raw_bank_change > 0)"))
    return out


add("content_findings", "\n UNION ALL ".join(content_rows()), "intents")
add("murl", f"SELECT *, {RANK.format('severity')} AS rank FROM inds WHERE source <> 'image'", "inds")


def url_rows():
    out = []
    titles = {
        "url.ip_host": ("0.9", "CASE WHEN bool_or(id='obfuscated_ip') THEN 'Link to an obfuscated IP address' ELSE 'Link to a raw IP address' END"),
        "url.obfuscation": ("0.92", "CASE WHEN bool_or(id='userinfo') THEN 'URL uses \"@\" to disguise its destination' ELSE 'Obfuscated URL' END"),
        "url.redirect": ("0.75", "CASE WHEN bool_or(id='shortener') THEN 'URL shortener hides the destination' ELSE 'Link redirects through another domain' END"),
        "url.suspicious_tld": ("0.6", "'Links to high-risk domains'"),
        "url.lookalike_domain": ("CASE WHEN max(rank)=5 THEN 0.95 ELSE 0.82 END", "'Link to a look-alike domain'"),
        "url.anchor_mismatch": ("0.93", "'Misleading link text'")}
    for k, (det, (cat, ids)) in enumerate(D.URL_DETECTORS.items()):
        conf, title = titles[det]
        out.append(f"SELECT msg_id, {100 + k} AS ord, {s(det)} AS detector, {s(cat)} AS category, {NAME.format('max(rank)')} AS severity, "
                   f"({conf})::DOUBLE AS confidence, {title} AS title, 'url' AS score_group, count(*) AS n_matches, "
                   "list(coalesce(nullif(registrable,''), nullif(host,''), 'URL')||' | '||url||' | '||id ORDER BY src_rank, pos, ord)[:6] AS evidence "
                   f"FROM murl WHERE {one_of('id', ids)} GROUP BY msg_id")
    return out


add("url_findings", "\n UNION ALL ".join(url_rows()), "murl")


def file_rows():
    return [f"SELECT msg_id, {300 + k} AS ord, {s(det)} AS detector, 'attachment' AS category, "
            f"{NAME.format('max(' + RANK.format('severity') + ')')} AS severity, {c}::DOUBLE AS confidence, {s(t)} AS title, "
            f"'attachment' AS score_group FROM file_inds WHERE {one_of('id', ids)} GROUP BY msg_id"
            for k, (det, (c, t, ids)) in enumerate(D.ATTACHMENT_DETECTORS.items())]


add("file_findings", "\n UNION ALL ".join(file_rows()), "file_inds")
add("mention", """
  SELECT s.msg_id, min_by(m.brand, m.ord) AS mention FROM sender s LEFT JOIN dim_official o ON o.domain = s.from_org
  JOIN dim_mention m ON regexp_matches(s.from_name, m.pattern) AND m.brand IS DISTINCT FROM o.brand
  GROUP BY s.msg_id""", "sender", "dim_official", "dim_mention")
add("facts", f"""
  SELECT s.*, a.* EXCLUDE (msg_id, from_domain, auth_headers), r.* EXCLUDE (msg_id), h.* EXCLUDE (msg_id), n.mention,
    k.like_brand, k.conf AS like_conf, hf.mixed_script AS sender_mixed, o.brand AS sender_brand,
    {one_of('s.from_org', D.FREE_MAIL)} AS sender_free, regexp_extract(s.from_name, '[A-Za-z0-9_.+-]+@([A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+)', 1) AS inside,
    regexp_matches(m.text, '(?i)sent from my (iphone|mobile)') AS mobile, {date_utc('v_date')} AS date_ts, m.created_at
  FROM sender s JOIN auth a USING (msg_id) JOIN routing r USING (msg_id) JOIN html_counts h USING (msg_id) JOIN messages m USING (msg_id)
  LEFT JOIN mention n USING (msg_id) LEFT JOIN lookalike k ON k.host = s.from_domain LEFT JOIN host_facts hf ON hf.host = s.from_domain
  LEFT JOIN dim_official o ON o.domain = s.from_org""",
    "sender", "auth", "routing", "html_counts", "messages", "mention", "lookalike", "host_facts", "dim_official")
FREE_REPLY = one_of("reply_org", D.FREE_MAIL)
OKD = "dmarc_state = 'pass'"
DRIFT = "epoch(date_ts) - epoch(origin_ts)"
head_rows = [
    row(1, "facts", "auth.spf", "authentication", ifel("spf_result='softfail'", "'medium'", "'high'"), "0.95",
        ifel("spf_result='softfail'", "'SPF soft fail'", "'SPF authentication failed'"), "authentication", "spf_state='fail'"),
    row(2, "facts", "auth.dkim", "authentication", "high", "0.9", "DKIM signature failed verification", "authentication", "dkim_state='fail'"),
    row(3, "facts", "auth.dmarc", "authentication", "critical", "0.95", "DMARC failed for the From domain", "authentication", "dmarc_state='fail'"),
    row(3, "facts", "auth.dmarc", "authentication", "info", "1.0", "No authentication results recorded", "authentication",
        "dmarc_state='not_present' AND auth_headers=0"),
    row(4, "facts", "header.reply_to_mismatch", "sender", ifel(f"{FREE_REPLY} OR like_brand IS NOT NULL", "'high'", "'medium'"), "0.85",
        ifel(FREE_REPLY, "'Replies diverted to a free-mail account'", "'Reply-To differs from sender organisation'"), "sender",
        "reply_domain <> '' AND reply_org <> from_org"),
    row(5, "facts", "header.return_path_mismatch", "sender", ifel(OKD, "'info'", "'low'"), ifel(OKD, "0.5", "0.7"),
        "Return-Path domain differs from From domain", "sender", "return_domain <> '' AND return_org <> from_org"),
    row(6, "facts", "header.received_chain", "header", "medium", "0.7", "Received chain timestamps go backwards", "header", "backwards"),
    row(7, "facts", "header.received_chain", "header", "low", "0.6", "Sending server has no reverse DNS", "header", "no_rdns"),
    row(8, "facts", "header.received_chain", "header", "low", "0.6", "Date header inconsistent with first relay", "header",
        f"{DRIFT} > 3600 OR {DRIFT} < -604800"),
    row(9, "facts", "header.anomalies", "header", "low", "0.6", "Sent with a scripting mail library", "header",
        f"regexp_matches(mailer, {s(D.SCRIPT_MAILERS)})"),
    row(10, "facts", "header.anomalies", "header", "high", "0.9", "Multiple From headers", "sender", "from_count > 1"),
    row(11, "facts", "header.anomalies", "header", "info", "0.5", "Missing Message-ID", "header", "message_id IS NULL"),
    row(12, "facts", "impersonation.display_name", "impersonation", "high", "0.9", "Display name contains a different email address",
        "impersonation", f"inside <> '' AND ({org('inside')}) <> from_org"),
    row(13, "facts", "impersonation.display_name", "impersonation", ifel("like_brand IS NOT NULL OR dmarc_state='fail'", "'critical'", "'high'"),
        ifel("like_brand IS NOT NULL", "0.95", "0.85"), "('Display name impersonates '||mention)", "impersonation", "mention IS NOT NULL"),
    row(14, "facts", "impersonation.lookalike_sender", "domain", ifel("like_conf >= 0.9", "'critical'", "'high'"), "like_conf",
        "Look-alike sender domain", "impersonation", "like_brand IS NOT NULL"),
    row(15, "facts", "impersonation.homoglyph", "impersonation", "critical", "0.96", "Homoglyph sender domain", "impersonation", "sender_mixed"),
    row(16, "(SELECT DISTINCT l.msg_id, l.host FROM link_risk l JOIN facts f USING (msg_id) WHERE l.mixed_script AND l.host <> f.from_domain)",
        "impersonation.homoglyph", "impersonation", "critical", "0.96", "Homoglyph link domain", "impersonation", "true"),
    row(17, "(SELECT f.*, i.* EXCLUDE (msg_id) FROM facts f JOIN intents i USING (msg_id))", "impersonation.executive", "impersonation", "critical",
        ifel("sender_free OR (reply_domain <> '' AND reply_domain <> from_domain)", "0.9", "0.75"), "Business email compromise pattern",
        "impersonation", f"(regexp_matches(from_name, {s(D.EXECUTIVE_TITLE)}) OR mobile) AND (raw_payment_request > 0 OR raw_gift_card > 0 OR "
        "raw_bank_change > 0) AND (raw_secrecy > 0 OR raw_urgency > 0)"),
]
add("head_findings", "\n UNION ALL ".join(head_rows), "facts", "link_risk", "intents")
late_rows = [
    row(110, "html_counts", "url.credential_harvesting", "url", "critical", "0.97", "Password form in the message", "credential_form", "password_forms > 0"),
    row(110, "html_counts", "url.credential_harvesting", "url", "high", "0.8", "Form in the message", "credential_form", "password_forms = 0 AND form_count > 0"),
    row(110, "(SELECT DISTINCT msg_id FROM murl JOIN html_counts USING (msg_id) WHERE form_count = 0 AND id IN ('credential_path', 'insecure_credential'))",
        "url.credential_harvesting", "url", "medium", "0.6", "Login-style link on a non-brand domain", "url", "true"),
    row(250, "html_counts", "content.hidden_text", "content", ifel("script_count > 0", "'high'", "'medium'"), "0.8",
        ifel("script_count > 0", "'Script content in HTML email'", "'Hidden text in HTML body'"), "content_hidden", "script_count > 0 OR hidden_count > 0"),
]
add("late_findings", "\n UNION ALL ".join(late_rows), "html_counts", "murl")
F8 = "msg_id, ord, detector, category, severity, confidence, title, score_group"
add("rule_findings", f"""SELECT {F8} FROM head_findings UNION ALL SELECT {F8} FROM url_findings UNION ALL SELECT {F8} FROM late_findings
  UNION ALL SELECT {F8} FROM content_findings UNION ALL SELECT {F8} FROM file_findings""",
    "head_findings", "url_findings", "late_findings", "content_findings", "file_findings")

# ---------------------------------------------------------------- reputation
add("feed", """
  SELECT provider, kind, target, feed_ts::TIMESTAMP AS feed_ts, CASE
    WHEN provider = 'VirusTotal' THEN CASE WHEN malicious >= 2 THEN 'malicious' WHEN malicious + suspicious > 0 THEN 'suspicious' ELSE 'clean' END
    WHEN provider = 'AbuseIPDB' THEN CASE WHEN score >= 75 THEN 'malicious' WHEN score >= 25 THEN 'suspicious' ELSE 'clean' END
    WHEN provider = 'URLScan' THEN CASE WHEN malicious > 0 THEN 'malicious' ELSE 'unknown' END
    WHEN provider = 'Google Safe Browsing' THEN CASE WHEN listed > 0 THEN 'malicious' ELSE 'clean' END
    WHEN provider = 'RDAP' AND date_diff('day', registered::DATE, feed_ts::DATE) < 30 THEN 'suspicious' ELSE 'unknown' END AS verdict
  FROM dim_reputation""", "dim_reputation")
add("ti_targets", """
  SELECT msg_id, 'domain' AS kind, target, ord FROM (
    SELECT msg_id, target, o, row_number() OVER (PARTITION BY msg_id ORDER BY o) - 1 AS ord FROM (
      SELECT msg_id, target, min(o) AS o FROM (
        SELECT msg_id, from_org AS target, -1 AS o FROM sender UNION ALL
        SELECT msg_id, registrable, src_rank * 1000 + pos FROM link_risk WHERE source <> 'image' AND registrable <> '')
      GROUP BY msg_id, target))
  UNION ALL SELECT msg_id, 'ip', origin_ip, 1000000 FROM routing WHERE origin_ip IS NOT NULL""", "sender", "link_risk", "routing")
add("ti_latest", "SELECT provider, kind, target, max_by(verdict, feed_ts) AS verdict FROM feed GROUP BY ALL", "feed")
add("ti_hits", "SELECT t.msg_id, t.ord, t.kind, t.target, f.provider, f.verdict FROM ti_targets t JOIN ti_latest f USING (kind, target)",
    "ti_targets", "ti_latest")
add("ti_findings", """
  SELECT msg_id, 1000 + ord * 10 + list_position(['VirusTotal', 'AbuseIPDB', 'URLScan', 'Google Safe Browsing', 'RDAP'], provider) AS ord, 'threat_intel.'||regexp_replace(lower(provider), '[^a-z0-9_]+', '_', 'g') AS detector, 'threat_intel' AS category,
    CASE WHEN verdict = 'malicious' THEN 'critical' ELSE 'medium' END AS severity,
    (CASE WHEN verdict = 'malicious' THEN 0.9 ELSE 0.6 END)::DOUBLE AS confidence,
    provider||': '||target||' reported '||verdict AS title, 'threat_intel' AS score_group
  FROM ti_hits WHERE verdict IN ('malicious', 'suspicious')""", "ti_hits")
add("findings_raw", f"SELECT {F8} FROM rule_findings UNION ALL SELECT {F8} FROM ti_findings", "rule_findings", "ti_findings")

# ---------------------------------------------------------------- trust and score
add("trust", """
  SELECT f.msg_id, f.dmarc_state = 'pass' AND coalesce(f.dmarc_aligned, true) AND f.like_brand IS NULL AND f.password_forms = 0
    AND NOT EXISTS (SELECT 1 FROM findings_raw x WHERE x.msg_id = f.msg_id AND x.detector IN ('impersonation.homoglyph', 'impersonation.display_name'))
    AND NOT EXISTS (SELECT 1 FROM link_risk l WHERE l.msg_id = f.msg_id AND ((l.source <> 'image' AND l.registrable <> ''
        AND l.registrable <> f.from_org AND (f.sender_brand IS NULL OR l.brand IS DISTINCT FROM f.sender_brand)) OR l.risk_rank >= 4))
    AND NOT EXISTS (SELECT 1 FROM file_risk a WHERE a.msg_id = f.msg_id AND a.risk_rank >= 4) AS trusted
  FROM facts f""", "facts", "findings_raw", "link_risk", "file_risk")
add("findings", """
  SELECT f.* REPLACE (CASE WHEN t.trusted AND f.category = 'content' AND f.detector NOT IN ('content.financial_request', 'content.hidden_text')
      THEN CASE f.severity WHEN 'critical' THEN 'medium' WHEN 'high' THEN 'low' ELSE 'info' END ELSE f.severity END AS severity),
    f.severity AS original, t.trusted FROM findings_raw f JOIN trust t USING (msg_id)""", "findings_raw", "trust")
add("group_scores", f"""
  SELECT msg_id, score_group, least(max(cap), sum(p * power(0.5, rn - 1)))::DOUBLE AS points, count(*) AS n FROM (
    SELECT f.msg_id, f.score_group, coalesce(c.cap, {D.DEFAULT_GROUP_CAP}) AS cap, s.points * f.confidence AS p,
      row_number() OVER (PARTITION BY f.msg_id, f.score_group ORDER BY s.points * f.confidence DESC, f.ord) AS rn
    FROM findings f JOIN dim_sev s USING (severity) LEFT JOIN dim_cap c USING (score_group))
  GROUP BY msg_id, score_group HAVING least(max(cap), sum(p * power(0.5, rn - 1))) > 0""", "findings", "dim_sev", "dim_cap")
LOGIT = "ln(least(greatest({0}, 1e-6), 1-1e-6) / (1 - least(greatest({0}, 1e-6), 1-1e-6)))"
add("score0", f"""
  SELECT m.msg_id, m.probability AS p, m.threshold AS t, tr.trusted,
    least(100, coalesce((SELECT sum(points) FROM group_scores g WHERE g.msg_id = m.msg_id), 0))::DOUBLE AS rule,
    coalesce(f.ncat, 0) AS ncat, coalesce(f.crit, false) AS crit, coalesce(f.strong, false) AS strong, coalesce(f.n, 0) AS finding_count,
    coalesce(f.ncrit, 0) AS critical_count, coalesce(f.nhigh, 0) AS high_count,
    CASE WHEN abs({LOGIT.format('m.probability')} - {LOGIT.format('m.threshold')}) >= 3 THEN 'high'
         WHEN abs({LOGIT.format('m.probability')} - {LOGIT.format('m.threshold')}) >= 1.2 THEN 'medium' ELSE 'low' END AS conf
  FROM model_scores m JOIN trust tr USING (msg_id) LEFT JOIN (
    SELECT msg_id, count(DISTINCT category) FILTER (WHERE severity IN ('critical','high')) AS ncat, bool_or(severity='critical') AS crit,
      bool_or(severity='critical' AND confidence >= 0.9) AS strong, count(*) AS n, count(*) FILTER (WHERE severity='critical') AS ncrit,
      count(*) FILTER (WHERE severity='high') AS nhigh FROM findings GROUP BY msg_id) f USING (msg_id)""",
    "model_scores", "trust", "group_scores", "findings")
add("score1", """
  SELECT *, CASE WHEN ncat >= 4 THEN 12 WHEN ncat >= 3 THEN 8 ELSE 0 END AS bonus, CASE WHEN abs(mlp) >= 0.1 THEN mlp END AS ml FROM (
  SELECT *, CASE WHEN p >= t THEN
      (CASE WHEN rule < 10 THEN least((6 + 14*((p-t)/greatest(1e-6, 1-t))) * CASE WHEN conf='low' THEN 0.5 ELSE 1 END, 8)
            ELSE (6 + 14*((p-t)/greatest(1e-6, 1-t))) * CASE WHEN conf='low' THEN 0.5 ELSE 1 END END) * CASE WHEN trusted THEN 0.25 ELSE 1 END
    WHEN p < t AND crit THEN 0 WHEN p < t THEN -8*((t-p)/greatest(1e-6, t)) END AS mlp FROM score0)""", "score0")
add("score2", """
  SELECT *, CASE WHEN strong AND curve < 60 THEN 60 ELSE curve END AS final FROM (
    SELECT *, rule + bonus + coalesce(ml, 0) AS raw, CASE WHEN rule + bonus + coalesce(ml, 0) <= 0 THEN 0
      ELSE 100*(1-exp(-(rule + bonus + coalesce(ml, 0))/60)) END AS curve FROM score1)""", "score1")
add("verdicts", f"""
  SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium'
      WHEN risk_score >= 20 THEN 'low' ELSE 'safe' END AS risk_level,
    CASE WHEN risk_score >= 60 THEN 'phishing' WHEN risk_score >= 35 THEN 'suspicious' ELSE 'legitimate' END AS classification,
    {steady_up('rule', 1)} AS rule_score, {steady_up('greatest(0, raw)', 1)} AS raw_points
  FROM (SELECT s.*, least(100, greatest(0, floor(round(final, 6) + 0.5)))::INTEGER AS risk_score, m.created_at, m.source_name, m.subject, m.label,
      f.from_address AS sender_address, f.from_domain AS sender_domain, sha256(m.header_block||chr(13)||chr(10)||chr(13)||chr(10)||m.text) AS message_sha256
    FROM score2 s JOIN messages m USING (msg_id) JOIN facts f USING (msg_id))""", "score2", "messages", "facts")
