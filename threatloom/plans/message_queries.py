"""Message tables, text, headers, attachments."""

from pyspark.sql import functions as F

from .. import dimensions as D
from .. import fixtures as fx
from ..functions import attachments as A
from ..functions import headers as H
from ..functions import text as X
from ..functions.hosts import is_private_ip
from ..operators import intents
from ..oracle.cte import one_of, s, with_
from .analysis import header_facts
from .registry import query


def _headers(spark, d):
    return fx.messages(spark, d).selectExpr("msg_id", f"inline({H.header_array('header_block')})")


@query("msg1_header_split", with_("messages") + """
SELECT msg_id, length(header_block)::BIGINT AS header_chars, length(text)::BIGINT AS body_chars,
  regexp_matches(header_block, '^[!-9;-~]+:') AS valid FROM messages""")
def msg1(spark, d):
    raw = fx.messages(spark, d).selectExpr("msg_id", "concat(header_block, '\\r\\n\\r\\n', text) AS raw")
    return raw.selectExpr("msg_id", f"{H.split_block('raw')} AS p").selectExpr(
        "msg_id", "length(p.header_block) AS header_chars", "length(p.body) AS body_chars", "p.valid AS valid")


@query("msg2_header_table", with_("headers") + "SELECT msg_id, pos::BIGINT AS pos, name, value FROM headers")
def msg2(spark, d):
    return _headers(spark, d)


@query("msg3_header_lookup", with_("headers") + """
SELECT msg_id, min_by(value, pos) FILTER (WHERE lower(name) = 'from') AS first_from,
  count(*) FILTER (WHERE lower(name) = 'from')::BIGINT AS n_from, min_by(value, pos) FILTER (WHERE lower(name) = 'x-mailer') AS x_mailer,
  min_by(value, pos) FILTER (WHERE lower(name) = 'received') AS top_received FROM headers GROUP BY msg_id""")
def msg3(spark, d):
    h = fx.messages(spark, d).selectExpr("msg_id", f"{H.header_array('header_block')} AS h")
    return h.selectExpr("msg_id", f"{H.first_of('h', 'from')} AS first_from", f"size({H.values_of('h', 'From')}) AS n_from",
                        f"{H.first_of('h', 'x-mailer')} AS x_mailer", f"{H.first_of('h', 'received')} AS top_received")


@query("msg4_mailbox_normalise", with_("sender") + """
SELECT msg_id, from_name, from_address, from_domain, reply_address, reply_domain, return_path, return_domain, from_org FROM sender""")
def msg4(spark, d):
    return header_facts(fx.messages(spark, d)).selectExpr(
        "msg_id", "from_name", "from_address", "from_domain", "try_element_at(reply_to, 1) AS reply_address", "reply_domain",
        "return_path", "return_domain", "from_org")


@query("msg5_mime_ingest", with_("messages") + """
SELECT msg_id, subject, text AS plain, 0::BIGINT AS n_attachments, CAST(NULL AS VARCHAR) AS parse_error FROM messages""")
def msg5(spark, d):
    from ..sources.mail import ingest
    raw = fx.messages(spark, d).selectExpr("msg_id", "encode(concat(header_block, '\\r\\n\\r\\n', text), 'UTF-8') AS content")
    return ingest(raw, "msg_id").selectExpr("msg_id", "subject", "plain", "size(attachments) AS n_attachments", "parse_error")


@query("msg6_mime_parts", with_("messages") + """
SELECT 'text/plain' AS content_type, count(*)::BIGINT AS n_parts, count(*)::BIGINT AS n_messages,
  sum(length(text))::BIGINT AS chars FROM messages""")
def msg6(spark, d):
    from ..sources.mail import ingest
    raw = fx.messages(spark, d).selectExpr("msg_id", "encode(concat(header_block, '\\r\\n\\r\\n', text), 'UTF-8') AS content")
    return ingest(raw, "msg_id").selectExpr("msg_id", "inline(parts)").groupBy("content_type").agg(
        F.count("*").alias("n_parts"), F.count_distinct("msg_id").alias("n_messages"), F.sum("size").alias("chars"))


@query("msg7_parse_warnings", with_("sender") + """
SELECT msg_id, concat_ws(',', CASE WHEN v_from IS NULL THEN 'no From header' END,
  CASE WHEN from_count > 1 THEN 'more than one From header' END) AS warnings FROM sender""")
def msg7(spark, d):
    f = header_facts(fx.messages(spark, d))
    return f.selectExpr("msg_id", f"""concat_ws(',', IF(from_count = 0, 'no From header', NULL),
      IF({H.first_of('headers', 'date')} IS NOT NULL AND date IS NULL, 'Date header could not be parsed', NULL),
      IF(from_count > 1, 'more than one From header', NULL)) AS warnings""")


@query("msg8_body_choose", r"""
SELECT page_id, CASE WHEN t = '' THEN 'none' ELSE 'html' END AS text_source, length(t)::BIGINT AS chars, md5(t) AS text_md5 FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>', ' ', 'g'),
    '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""")
def msg8(spark, d):
    from ..functions.html import visible_text
    pages = fx.table(spark, d, "pages").selectExpr("page_id", "CAST(NULL AS string) AS plain", f"{visible_text('html')} AS shown")
    return pages.selectExpr("page_id", "replace(coalesce(nullif(trim(plain), ''), shown), '\\r\\n', '\\n') AS body",
                            "trim(plain) <> '' AS has_plain").selectExpr(
        "page_id", "CASE WHEN body = '' THEN 'none' WHEN has_plain THEN 'plain' ELSE 'html' END AS text_source",
        "length(body) AS chars", "md5(body) AS text_md5")


@query("msg9_html_elements", r"""
SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s'))::BIGINT AS anchors, (page_id % 3 = 1)::BIGINT AS forms,
  CASE WHEN page_id % 3 = 1 THEN 'pw,' || page_id ELSE '' END AS inputs, CASE WHEN page_id % 4 = 1 THEN '/i' || page_id || '.png' ELSE '' END AS images,
  CASE WHEN page_id % 5 = 1 THEN 'page ' || page_id ELSE '' END AS hidden,
  len(regexp_extract_all(html, '(?i)<script'))::BIGINT + (page_id % 6 = 1)::BIGINT AS scripts FROM pages""")
def msg9(spark, d):
    """Pages as given, some with a form, an image, a concealed element or one more script added."""
    from ..functions.html import inspect_html
    more = """concat(html, IF(page_id % 3 = 1, concat('<FORM method="POST" action=/p><input type=password name="pw"><input name=', page_id, '></form>'), ''),
      IF(page_id % 4 = 1, concat("<img alt='' src='/i", page_id, ".png'>"), ''),
      IF(page_id % 5 = 1, concat('<div class="x" style="color:red; display : none"><b>page</b> ', page_id, '</div>'), ''),
      IF(page_id % 6 = 1, '<script src="x.js"></script>', ''))"""
    pages = fx.table(spark, d, "pages").selectExpr("page_id", f"{more} AS html").select("page_id", inspect_html("html").alias("h"))
    return pages.selectExpr("page_id", "size(h.anchors) AS anchors", "size(filter(h.forms, f -> f.password AND f.method = 'post')) AS forms",
                            "concat_ws(',', flatten(transform(h.forms, f -> f.inputs))) AS inputs", "concat_ws(',', h.images) AS images",
                            "concat_ws(',', h.hidden) AS hidden", "h.scripts AS scripts")


@query("msg9_html_anchors", r"""
SELECT page_id, pos::BIGINT AS pos, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href,
  trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)^<a\s[^>]*>(.*)</a>$', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
FROM (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS a FROM (
  SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>') AS l FROM pages))""")
def msg9a(spark, d):
    from ..functions.html import anchor_array
    return fx.table(spark, d, "pages").selectExpr("page_id", f"posexplode({anchor_array('html')}) AS (pos, a)").selectExpr(
        "page_id", "pos", "a.href AS href", "a.text AS text")


@query("msg10_html_text", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>', ' ', 'g'),
    '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def msg10(spark, d):
    """Visible text; whole documents."""
    from ..functions.html import inspect_html
    return fx.table(spark, d, "pages").select("page_id", inspect_html("html").alias("h")).selectExpr(
        "page_id", "h.visible AS text")


@query("msg11_clean_line", r"""
SELECT doc_id, md5(CASE WHEN length(t) > 500 THEN substring(t, 1, 500)||'…' ELSE t END) AS line_md5 FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents)""")
def msg11(spark, d):
    return fx.table(spark, d, "documents").selectExpr("doc_id", f"md5({X.clean_line('text')}) AS line_md5")


@query("msg12_defang", "SELECT page_id, replace(regexp_replace(url, '(?i)^http', 'hxxp'), '.', '[.]') AS safe_url FROM pages")
def msg12(spark, d):
    return fx.table(spark, d, "pages").selectExpr("page_id", f"{X.defang('url')} AS safe_url")


@query("msg13_content_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def msg13(spark, d):
    return fx.table(spark, d, "documents").selectExpr("doc_id", "sha2(text, 256) AS sha256", "md5(text) AS md5")


@query("msg14_filename_sanitise", with_("file_risk") + "SELECT msg_id, filename, extension FROM file_risk")
def msg14(spark, d):
    return A.analyse(fx.message_files(spark, d)).select("msg_id", "filename", "extension")


# ------------------------------------------------------------------ text
def _scrub(e):
    for p in D.ARTEFACT_PATTERNS:
        e = f"regexp_replace({e}, {s(p)}, ' ', 'g')"
    return e


def _mask(e):
    for p, r in ((D.MASK_URL, " urltoken "), (D.MASK_EMAIL, " emailtoken "), (D.MASK_NUMBER, " 0 ")):
        e = f"regexp_replace({e}, {s(p)}, {s(r)}, 'g')"
    return f"lower(trim(regexp_replace({e}, '\\s+', ' ', 'g')))"


def _subject(e):
    return f"regexp_replace(regexp_replace({e}, {s(D.SUBJECT_PREFIX)}, ''), {s(D.LIST_TAG)}, ' ', 'g')"


NORMAL_SQL = _mask(_scrub(f"({_subject('subject')}||chr(10)||text)"))


@query("txt1_artefact_scrub", f"SELECT doc_id, md5({_scrub('text')}) AS scrubbed_md5 FROM documents")
def txt1(spark, d):
    return fx.table(spark, d, "documents").selectExpr("doc_id", f"md5({X.scrub_artefacts('text')}) AS scrubbed_md5")


@query("txt2_subject_clean", with_("messages") + f"SELECT msg_id, {_subject('subject')} AS subject FROM messages")
def txt2(spark, d):
    return fx.messages(spark, d).selectExpr("msg_id", f"{X.clean_subject('subject')} AS subject")


@query("txt3_mask_normalise", with_("messages") + f"SELECT msg_id, length({NORMAL_SQL})::BIGINT AS chars, sha256({NORMAL_SQL}) AS sha256 FROM messages")
def txt3(spark, d):
    m = fx.messages(spark, d).selectExpr("msg_id", f"{X.normalise('subject', 'text')} AS t")
    return m.selectExpr("msg_id", "length(t) AS chars", "sha2(t, 256) AS sha256")


def alpha(e, n=1):
    return f"list_filter(string_split_regex({e}, '\\s+'), lambda t: regexp_matches(t, '^\\p{{L}}{{{n},}}$'))"


@query("txt4_is_english", f"""SELECT doc_id, len(t) >= 8 AND len(list_filter(t, lambda x: {one_of('x', D.STOPWORDS)})) / greatest(len(t), 1) >= 0.12 AS english
FROM (SELECT doc_id, {alpha('text')} AS t FROM documents)""")
def txt4(spark, d):
    t = fx.table(spark, d, "documents").selectExpr("doc_id", f"{X.alpha_tokens('text')} AS t")
    return t.selectExpr("doc_id", f"coalesce({X.english_ratio('t')}, 0.0D) >= {D.MIN_ENGLISH_RATIO}D AS english")


@query("txt5_vocab_coverage", f"""
WITH toks AS (SELECT doc_id, unnest({alpha('lower(text)', 2)}) AS w FROM documents),
vocab AS (SELECT w FROM toks GROUP BY w HAVING count(DISTINCT doc_id) >= 3)
SELECT d.doc_id, coalesce(round(avg(CASE WHEN v.w IS NOT NULL THEN 1.0 WHEN t.w IS NOT NULL THEN 0.0 END)::DOUBLE, 6), 0.0) AS coverage
FROM documents d LEFT JOIN toks t ON d.doc_id = t.doc_id LEFT JOIN vocab v ON t.w = v.w GROUP BY d.doc_id""")
def txt5(spark, d):
    """Share of words the vocabulary (three documents or more) knows."""
    from ..operators.terms import coverage, document_frequency
    docs = fx.table(spark, d, "documents").selectExpr("doc_id", f"{X.alpha_tokens('lower(text)', 2)} AS terms")
    vocabulary = document_frequency(docs).where("df >= 3").select("term")
    return coverage(docs, vocabulary, "doc_id")


@query("txt6_phrase_match", with_("raw_intents") + "SELECT msg_id, " + ", ".join(f"round(raw_{i}, 4) AS raw_{i}" for i in D.INTENTS) + " FROM raw_intents")
def txt6(spark, d):
    df = intents.raw_scores(fx.messages(spark, d).select("msg_id", "subject", "text"))
    return df.selectExpr("msg_id", *[f"round(raw_{i}, 4) AS raw_{i}" for i in D.INTENTS])


def span_sql() -> str:
    """CTE spans(msg_id, intent, s, e, q): matches of each phrase by their place, then the first-come choice in the order of phrases."""
    each = []
    for i, (_, phrases) in D.INTENTS.items():
        for k, (p, _) in enumerate(phrases):
            each.append(f"SELECT msg_id, '{i}' AS intent, {k} AS k, regexp_extract_all(text, {s('(?i)' + p)}) AS m, string_split_regex(text, {s('(?i)' + p)}) AS g "
                        f"FROM messages WHERE regexp_matches(text, {s('(?i)' + p)})")
    return f""", matched AS MATERIALIZED ({' UNION ALL '.join(each)}),
placed AS (SELECT msg_id, intent, k, m[j] AS q, (list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM matched)),
offered AS (SELECT msg_id, intent, list({{'s': s, 'e': s + length(q), 'q': q}} ORDER BY k, s) AS c FROM placed WHERE trim(q) <> '' GROUP BY msg_id, intent),
spans AS MATERIALIZED (SELECT msg_id, intent, x.s AS s, x.e AS e, x.q AS q FROM (SELECT msg_id, intent, unnest(list_reduce(list_transform(c, lambda x: [x]),
  lambda a, x: CASE WHEN len(list_filter(a, lambda t: t.s < x[1].e AND t.e > x[1].s)) > 0 THEN a ELSE list_concat(a, x) END)) AS x FROM offered))
"""


@query("txt7_phrase_spans", with_("messages") + span_sql() + "SELECT msg_id, intent, s AS start, e AS \"end\", q AS quote FROM spans")
def txt7(spark, d):
    """Accepted spans per intent with code point offsets."""
    return intents.spans_of(fx.messages(spark, d))


def _with_intents(spark, d):
    from ..operators import links
    m = intents.raw_scores(fx.messages(spark, d).selectExpr("msg_id", "subject", "text", "html RLIKE '(?i)<form' AS has_form"))
    linked = links.dedup(fx.message_links(spark, d)).where("source <> 'image'").select("msg_id").distinct()
    m = m.join(linked.withColumn("has_link", F.lit(True)), "msg_id", "left")
    return intents.in_context(m.selectExpr("* EXCEPT (has_link, has_form)",
                                           "coalesce(has_link, false) OR coalesce(has_form, false) AS call_to_action"))


@query("txt8_intent_context", with_("intents") + "SELECT msg_id, cta AS call_to_action, " + ", ".join(
    f"round(score_{i}, 4) AS score_{i}" for i in D.INTENTS) + " FROM intents")
def txt8(spark, d):
    return _with_intents(spark, d).selectExpr("msg_id", "call_to_action", *[f"round(score_{i}, 4) AS score_{i}" for i in D.INTENTS])


@query("txt9_evidence_quotes", with_("messages") + span_sql() + """SELECT msg_id, intent, array_to_string(list(quote ORDER BY first_at, quote)[1:6], ' | ') AS quotes FROM (
  SELECT msg_id, intent, trim(q) AS quote, min(s) AS first_at FROM spans GROUP BY ALL) GROUP BY msg_id, intent""")
def txt9(spark, d):
    """First six distinct quotes per message and intent."""
    spans = intents.spans_of(fx.messages(spark, d))
    first = spans.selectExpr("msg_id", "intent", "trim(quote) AS quote", "start").groupBy("msg_id", "intent", "quote").agg(
        F.min("start").alias("start"))
    return first.groupBy("msg_id", "intent").agg(F.expr(
        "array_join(transform(slice(array_sort(collect_list(struct(start, quote))), 1, 6), x -> x.quote), ' | ')").alias("quotes"))


@query("txt10_brand_mention", with_("sender", "mention") + """
SELECT s.msg_id, m.mention AS brand FROM sender s LEFT JOIN mention m USING (msg_id)""")
def txt10(spark, d):
    from ..operators.detectors import mentioned_brand
    return header_facts(fx.messages(spark, d)).selectExpr("msg_id", f"{mentioned_brand('from_name', 'sender_brand')} AS brand")


@query("int_agg_intent_finding", with_("content_findings") + span_sql() + f"""
, rules(detector, title, intent) AS (VALUES {', '.join(f"({s(det)}, {s(title)}, '{i}')" for det, title, ids, _ in D.INTENT_RULES for i in ids)}),
quoted AS (SELECT msg_id, detector, title, array_to_string(list(quote ORDER BY first_at, quote)[1:6], ' | ') AS quotes FROM (
  SELECT msg_id, detector, title, trim(q) AS quote, min(s) AS first_at FROM spans JOIN rules USING (intent) GROUP BY ALL) GROUP BY msg_id, detector, title)
SELECT f.msg_id, f.detector, f.severity, f.confidence, f.title, f.score_group, coalesce(x.quotes, '') AS quotes FROM content_findings f
LEFT JOIN quoted x ON x.msg_id = f.msg_id AND x.detector = f.detector AND (x.title = f.title OR f.detector = 'content.financial_request')""")
def int_agg(spark, d):
    """Findings of the content rules, with the quotes that they rest on."""
    from ..functions.sqltext import array_of
    texts = intents.with_spans(fx.messages(spark, d).select("msg_id", "text")).select("msg_id", "spans")
    df = intents.with_rule_scores(_with_intents(spark, d)).join(texts, "msg_id")
    return df.selectExpr("msg_id", f"inline({array_of(*intents.content_findings('spans'))})").selectExpr(
        "msg_id", "detector", "severity", "confidence", "title", "score_group", "array_join(evidence, ' | ') AS quotes")


# ------------------------------------------------------------------ headers
@query("hdr1_auth_results", with_("auth") + "SELECT msg_id, spf_result, dkim_result, dmarc_result, spf_domain, dkim_domain, dmarc_domain FROM auth")
def hdr1(spark, d):
    return header_facts(fx.messages(spark, d)).select("msg_id", "spf_result", "dkim_result", "dmarc_result", "spf_domain",
                                                      "dkim_domain", "dmarc_domain")


@query("hdr2_auth_summary", with_("auth") + """
SELECT msg_id, spf_state, dkim_state, dmarc_state, spf_aligned, dkim_aligned, dmarc_aligned, auth_headers::BIGINT AS auth_headers FROM auth""")
def hdr2(spark, d):
    return header_facts(fx.messages(spark, d)).select("msg_id", "spf_state", "dkim_state", "dmarc_state", "spf_aligned",
                                                      "dkim_aligned", "dmarc_aligned", "auth_headers")


def _hops(spark, d):
    return header_facts(fx.messages(spark, d)).selectExpr("msg_id", "inline(hops)")


@query("hdr3_received_parse", with_("hopflags") + """
SELECT msg_id, hop::BIGINT AS hop, sender, from_ip, by_host, with_proto, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM hopflags""")
def hdr3(spark, d):
    return _hops(spark, d).selectExpr("msg_id", "hop", "sender", "from_ip", "by AS by_host", "`with` AS with_proto", "ts")


@query("hdr4_received_chain", with_("hopflags") + f"""
SELECT msg_id, hop::BIGINT AS hop, delay_seconds, concat_ws('; ', CASE WHEN no_rdns THEN '{H.NO_RDNS}' END,
  CASE WHEN no_time THEN '{H.NO_TIME}' END, CASE WHEN backwards THEN '{H.BACKWARDS}' WHEN late THEN '{H.LATE}' END) AS flags FROM hopflags""")
def hdr4(spark, d):
    return _hops(spark, d).selectExpr("msg_id", "hop", "delay_seconds", "array_join(flags, '; ') AS flags")


@query("hdr4_event_lag", """
SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events""")
def hdr4_events(spark, d):
    """The same previous-row delay over the events table; a busy user is cut into days."""
    from ..operators.windows import bucketed_lag
    ev = fx.table(spark, d, "events").selectExpr("event_id", "user_id", "unix_micros(CAST(ts AS timestamp)) AS us",
                                                 "to_date(ts) AS day")
    return bucketed_lag(ev, ["user_id"], "day", ["us", "event_id"], "us", "before").selectExpr(
        "event_id", "user_id", "us - before AS gap_us")


@query("hdr5_date_drift", with_("facts") + """
SELECT msg_id, (epoch(date_ts) - epoch(origin_ts))::BIGINT AS drift_seconds,
  coalesce(epoch(date_ts) - epoch(origin_ts) > 3600 OR epoch(date_ts) - epoch(origin_ts) < -604800, false) AS suspicious FROM facts""")
def hdr5(spark, d):
    f = header_facts(fx.messages(spark, d)).selectExpr(
        "msg_id", "unix_timestamp(date) - unix_timestamp(try_element_at(hops, 1).ts) AS drift_seconds")
    return f.selectExpr("*", "coalesce(drift_seconds > 3600 OR drift_seconds < -604800, false) AS suspicious")


@query("dom12_private_ip", with_("hopflags") + """
SELECT DISTINCT from_ip, regexp_matches(from_ip, '^(10|127|192\\.168|169\\.254|172\\.(1[6-9]|2[0-9]|3[01]))\\.') AS private
FROM hopflags WHERE from_ip IS NOT NULL""")
def dom12(spark, d):
    return _hops(spark, d).where("from_ip IS NOT NULL").select("from_ip").distinct().selectExpr(
        "from_ip", f"{is_private_ip('from_ip')} AS private")


# ------------------------------------------------------------------ attachments
@query("att1_ext_chain", with_("files2") + "SELECT msg_id, array_to_string(chain, '.') AS chain, ext AS extension FROM files2")
def att1(spark, d):
    f = fx.message_files(spark, d).selectExpr("msg_id", f"{A.extension_chain(A.sanitise_filename('filename'))} AS c")
    return f.selectExpr("msg_id", "array_join(c, '.') AS chain", "coalesce(try_element_at(c, -1), '') AS extension")


@query("att2_magic_sniff", with_("files2") + "SELECT msg_id, detected_type FROM files2")
def att2(spark, d):
    return fx.message_files(spark, d).selectExpr("msg_id", f"{A.sniff_type('content')} AS detected_type")


@query("att3_att_indicators", with_("file_risk") + """
SELECT msg_id, filename, size::BIGINT AS size, sha256, md5, risk_rank::BIGINT AS risk_rank, coalesce(indicator_ids, '') AS indicators FROM file_risk""")
def att3(spark, d):
    return A.analyse(fx.message_files(spark, d)).selectExpr(
        "msg_id", "filename", "size", "sha256", "md5", "risk_rank", "array_join(transform(indicators, i -> i.id), ',') AS indicators")


@query("att4_archive_inventory", with_("files2") + f"""
SELECT DISTINCT sha256, unnest([{', '.join(s(e) for e in fx.ZIP_ENTRIES)}]) AS entry FROM files2 WHERE detected_type LIKE 'application/zip%'""")
def att4(spark, d):
    """Entry names per distinct archive."""
    files = fx.message_files(spark, d).where(F.expr(f"startswith({A.sniff_type('content')}, 'application/zip')"))
    unique = files.selectExpr("sha2(content, 256) AS sha256", "content").groupBy("sha256").agg(
        F.any_value("content").alias("content"))
    return unique.select("sha256", F.explode(A.archive_entries("content")).alias("entry"))
