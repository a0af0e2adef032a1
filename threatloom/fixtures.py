"""Message corpus derived from the driver's tables.

The documents table carries no mail structure, so every document becomes a
message by completing it from small literal dimensions chosen by
``doc_id % size``. Sizes are pairwise coprime, so combinations vary. Nothing
here is sampled: the corpus has exactly one message per document row.
"""

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.shared import spread


def _zip_hex(names):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        for n in names:
            z.writestr(zipfile.ZipInfo(n, (2024, 1, 1, 0, 0, 0)), b"x")
    return buf.getvalue().hex().upper()


ZIP_ENTRIES = ["docs/readme.txt", "payload.js"]

DIM_SENDER = ("k display_name address reply_to return_path mailer", [
    (0, "Microsoft Account Team", "security@micr0soft-accountprotection.com", "helpdesk@mail-verify.top",
     "bounce@mailer.sendfast.net", "PHPMailer 6.1"),
    (1, "PayPal", "service@paypal.com", None, "bounce@paypal.com", None),
    (2, "Anna Keller", "anna.keller@northwind-trading.com", None, "anna.keller@northwind-trading.com",
     "Thunderbird 115"),
    (3, "DHL Express", "notice@dhl-parcel-redelivery.top", None, "notice@dhl-parcel-redelivery.top", None),
    (4, "James Porter, CEO", "j.porter@example.org", "James.Porter.CEO@gmail.com", "j.porter@example.org", None),
    (5, "Apple Support", "no-reply@xn--pple-43d.com", None, "no-reply@xn--pple-43d.com", None),
    (6, "GitHub", "noreply@github.com", "noreply@github.com", "bounces@mail.github.com", None),
    (7, "billing@paypal.com via Notices", "alerts@notices-hub.co.uk", None, "alerts@notices-hub.co.uk", None),
    (8, "Maria Lopez", "maria.lopez@gmail.com", None, "maria.lopez@gmail.com", None),
    (9, "Google", "no-reply@accounts.google.com", None, "bounces@google.com", None),
    (10, "IT Service Desk", "it@paypa1.com", "it@paypa1.com", "x@cheap-esp.net", "SwiftMailer 5"),
])

# {d} stands for the domain of the From address.
DIM_AUTH = ("k auth_top auth_low received_spf dkim_signature", [
    (0, "mx.example.org; spf=pass (sender ok) smtp.mailfrom=bounce@{d}; dkim=pass header.d={d}; "
        "dmarc=pass (p=reject) header.from={d}", None, None, "v=1; a=rsa-sha256; d={d}; s=s1"),
    (1, "mx.example.org; spf=fail (not permitted) smtp.mailfrom=attacker@bad-host.net; dkim=none; "
        "dmarc=fail (p=reject) header.from={d}", None, None, None),
    (2, "mx.example.org; spf=softfail smtp.mailfrom=x@sendfast.net; dkim=fail header.i=@{d}; "
        "dmarc=fail header.from={d}", None, "softfail (mx.example.org) client-ip=203.0.113.5", "v=1; d={d}"),
    (3, "spf=temperror smtp.helo=mail.{d}; dkim=pass header.d=esp-mailer.net; dmarc=none header.from={d}", None, None,
     "v=1; d=esp-mailer.net"),
    (4, None, None, None, None),
    (5, None, None, "Fail (mx.example.org: domain does not designate) envelope-from=<bounce@sendfast.net>; x=y",
     "v=1; d={d}"),
    (6, "inbox.example.net; dmarc=pass header.from=other-brand.com; SPF=pass smtp.mailfrom={d}",
     "forged.example; dmarc=pass header.from={d}; spf=fail", None, None),
])

DIM_LINK = ("k source url anchor_text", [
    (0, "anchor", "https://google.com@evil.example/login", "Review activity"),
    (1, "text", "http://203.0.113.5/a", None),
    (2, "anchor", "http://3232235777/x", "Statement"),
    (3, "text", "https://bit.ly/abc", None),
    (4, "anchor", "https://pay-now.top/x?utm=1", "Pay the fee"),
    (5, "anchor", "https://www.google.com/url?q=x&url=https://evil.example/p", "Read more"),
    (6, "text", "https://cdn.example.net/files/invoice.exe", None),
    (7, "anchor", "javascript:alert(1)", "Open"),
    (8, "anchor", "https://evil.example/login", "https://account.microsoft.com/security"),
    (9, "anchor", "https://github.com/settings", "github.com/settings"),
    (10, "form", "https://login.secure-example.top/verify", None),
    (11, "anchor", "https://paypal.com.secure-login.top/session", "paypal.com"),
    (12, "anchor", "https://xn--pple-43d.com/id", "Apple ID"),
    (13, "image", "https://tracker.a.b.c.d.example.net:8080/p.gif?%41%42%43", None),
    (14, "text", "https://www.paypal.com/signin", None),
    (15, "anchor", "http://por%74al.co.uk/a%20b%20c%20d%20e%20f%20g%20h%20i%20j%20k%20l%20m%20n", "portal"),
    (16, "text", "https://accounts.google.com/continue?continue=https://mail.google.com/", None),
])

DIM_LURE = ("k subject sentence html label", [
    (0, "Your account will be suspended", "Your account will be suspended within 24 hours unless you verify your "
        "credentials immediately.", "<div style=\"display:none\">offer weather garden</div><p>Dear user</p>"
        "<form action=\"https://login.secure-example.top/verify\" method=\"post\"><input type=\"password\" "
        "name=\"pw\"></form>", "phishing"),
    (1, "Re: [team] notes", "Hi team, the meeting notes from Tuesday are attached. See you at lunch.", None,
     "legitimate"),
    (2, "Quick favour", "Are you at your desk? I need you to buy four gift cards and send me the codes. "
        "Keep this confidential. Sent from my iPhone", None, "phishing"),
    (3, "Summer sale", "Limited time: 20% off this week only. Hurry, sale expires Sunday!",
     "<html><head><title>Sale</title></head><body><h1>Sale</h1><img src=\"https://cdn.example.net/b.png\"></body>"
     "</html>", "legitimate"),
    (4, "Overdue invoice", "The invoice is 14 days overdue. Our bank details have been changed, please process the "
        "payment today by wire transfer.", None, "phishing"),
    (5, "Your parcel", "Your parcel could not be delivered. Pay the redelivery fee to schedule a new delivery.",
     "<p>Track</p><script>go()</script><iframe src=\"x\"></iframe>", "phishing"),
    (6, "You have won", "Congratulations! You have won the lottery, claim your prize before it is too late.", None,
     "phishing"),
    (7, "Password reset", "We received a request to reset your password. If this was you, sign in now.", None,
     "legitimate"),
    (8, "Security alert", "We noticed unusual sign-in activity. Please verify your identity and confirm your identity "
        "within the next 48 hours, failure to comply means permanent account closure.", None, "phishing"),
    (9, "Part-time job offer", "Work from home and earn: paying $500 per day. A refundable registration fee applies.",
     None, "phishing"),
    (10, "MFA", "Please approve the push notification and share your verification code with the IT support.", None,
     "phishing"),
    (11, "Board", "The CEO asked me to act now. Do not discuss this, I am in a meeting and cannot take calls.", None,
     "phishing"),
    (12, "Your receipt", "Thank you for your order. The invoice is available in your account.", None, "legitimate"),
])

DIM_FILE = ("k filename content_hex declared_type", [
    (0, None, None, None),
    (1, "notes.txt", "616263", "text/plain"),
    (2, "../invoices/Invoice.pdf.exe", "4D5A" + "00" * 16, "application/pdf"),
    (3, "report.docm", "504B", "application/octet-stream"),
    (4, "archive.zip", _zip_hex(ZIP_ENTRIES), "application/zip"),
])

DIM_CHAIN = ("k date_header hop_top hop_mid hop_low", [
    (0, "Mon, 1 Jan 2024 09:00:00 +0000",
     "from mx.example.org (mx.example.org [198.51.100.7]) by inbox.example.org with ESMTPS id a1; "
     "Mon, 1 Jan 2024 09:00:30 +0000",
     "from mail.sender.net (mail.sender.net [203.0.113.9]) by mx.example.org with ESMTP id b2; "
     "Mon, 1 Jan 2024 09:00:10 +0000", None),
    (1, "Mon, 1 Jan 2024 12:00:00 +0000",
     "from mx.example.org by inbox.example.org; Mon, 1 Jan 2024 09:00:00 +0000",
     "from unknown (unknown [203.0.113.77]) by mx.example.org; Mon, 1 Jan 2024 09:30:00 +0000 (UTC)", None),
    (2, "Mon, 1 Jan 2024 07:00:00 +0000",
     "from relay.example.org by inbox.example.org with ESMTPS id c9; Wed, 3 Jan 2024 10:00:00 +0000",
     "from localhost (unknown [10.0.0.4]) by relay.example.org with SMTP; Mon, 1 Jan 2024 08:00:00 +0100",
     "from app by localhost"),
])

# Reputation feed snapshots: one raw answer per provider, target and time.
DIM_REPUTATION = ("provider kind target score malicious suspicious listed registered feed_ts", [
    ("VirusTotal", "domain", "evil.example", 0, 5, 1, 0, None, "2024-01-01 00:10:00"),
    ("VirusTotal", "domain", "evil.example", 0, 0, 1, 0, None, "2024-01-05 00:00:00"),
    ("VirusTotal", "domain", "pay-now.top", 0, 1, 0, 0, None, "2024-01-02 00:00:00"),
    ("VirusTotal", "domain", "github.com", 0, 0, 0, 0, None, "2024-01-02 00:00:00"),
    ("AbuseIPDB", "ip", "203.0.113.77", 80, 0, 0, 0, None, "2024-01-01 06:00:00"),
    ("AbuseIPDB", "ip", "203.0.113.9", 30, 0, 0, 0, None, "2024-01-01 07:00:00"),
    ("AbuseIPDB", "ip", "10.0.0.4", 0, 0, 0, 0, None, "2024-01-01 08:00:00"),
    ("URLScan", "domain", "secure-login.top", 0, 2, 0, 0, None, "2024-01-03 00:00:00"),
    ("Google Safe Browsing", "domain", "evil.example", 0, 0, 0, 1, None, "2024-01-01 12:00:00"),
    ("RDAP", "domain", "secure-example.top", 0, 0, 0, 0, "2023-12-20", "2024-01-01 00:00:00"),
    ("RDAP", "domain", "google.com", 0, 0, 0, 0, "1997-09-15", "2024-01-01 00:00:00"),
])

ML_THRESHOLD = 0.5544
DIMS = {
    "dim_sender": DIM_SENDER, "dim_auth": DIM_AUTH, "dim_link": DIM_LINK, "dim_lure": DIM_LURE,
    "dim_file": DIM_FILE, "dim_chain": DIM_CHAIN, "dim_reputation": DIM_REPUTATION,
}
SIZES = {name: len(rows) for name, (_, rows) in DIMS.items()}


def _spark_lit(v):
    if v is None:
        return "CAST(NULL AS STRING)"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


def _duck_lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def inline_rows(spark: SparkSession, columns: str, rows) -> DataFrame:
    """A literal table that the optimizer sees as a local relation."""
    body = ", ".join("(" + ", ".join(_spark_lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns.split())})")


def duck_rows(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_duck_lit(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns.split())}) AS (VALUES {body})"


def dim(spark: SparkSession, name: str) -> DataFrame:
    return inline_rows(spark, *DIMS[name])


def duck_dim(name: str) -> str:
    return duck_rows(name, *DIMS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def _pick(df: DataFrame, spark: SparkSession, name: str, prefix: str) -> DataFrame:
    """Complete rows from a literal dimension (at most 17 rows, so always broadcast)."""
    d = dim(spark, name)
    d = d.select(*[F.col(c).alias(prefix + c) for c in d.columns])
    return df.join(F.broadcast(d), F.pmod("msg_id", F.lit(SIZES[name])) == F.col(prefix + "k")).drop(prefix + "k")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw message per document: header block, body text, optional HTML."""
    crlf = F.lit("\r\n")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"), F.col("text").alias("doc_text"))
    for name, prefix in (("dim_sender", "s_"), ("dim_auth", "a_"), ("dim_lure", "l_"), ("dim_chain", "c_")):
        docs = _pick(docs, spark, name, prefix)
    domain = F.substring_index("s_address", "@", -1)

    def header(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, crlf)).otherwise(F.lit(""))

    def filled(c):
        return F.replace(F.col(c), F.lit("{d}"), domain)

    fold = F.replace("c_hop_top", F.lit(" by "), F.lit("\r\n\tby "))
    block = F.concat(
        header("Return-Path", F.concat(F.lit("<"), "s_return_path", F.lit(">"))),
        header("Received", fold), header("Received", F.col("c_hop_mid")), header("Received", F.col("c_hop_low")),
        header("Authentication-Results", filled("a_auth_top")), header("Authentication-Results", filled("a_auth_low")),
        header("Received-SPF", F.col("a_received_spf")), header("DKIM-Signature", filled("a_dkim_signature")),
        header("From", F.concat(F.lit('"'), "s_display_name", F.lit('" <'), "s_address", F.lit(">"))),
        F.when(F.pmod("msg_id", F.lit(19)) == 18, F.lit("FROM: second@other.example\r\n")).otherwise(F.lit("")),
        header("Reply-To", F.col("s_reply_to")), F.lit("To: analyst@example.org\r\n"),
        header("Subject", F.col("l_subject")), header("Date", F.col("c_date_header")),
        F.when(F.pmod("msg_id", F.lit(23)) == 22, F.lit("")).otherwise(
            F.concat(F.lit("Message-ID: <m"), F.col("msg_id").cast("string"), F.lit("@example.org>\r\n"))),
        header("X-Mailer", F.col("s_mailer")), F.lit("MIME-Version: 1.0"))
    return docs.select(
        "msg_id",
        (F.lit(1704067200) + F.col("msg_id") * 43 * 60).cast("timestamp").alias("created_at"),
        F.concat(F.lit("doc-"), F.col("msg_id").cast("string"), F.lit(".eml")).alias("source_name"),
        F.col("l_subject").alias("subject"),
        F.concat("doc_text", F.lit(" "), "l_sentence").alias("text"),
        F.col("l_html").alias("html"), F.col("l_label").alias("label"), block.alias("header_block"))


def message_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three link candidates per message, in order of appearance."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"))
    slots = ids.select("msg_id", F.explode(F.sequence(F.lit(0), F.pmod("msg_id", F.lit(3)).cast("int"))).alias("pos"))
    link = F.broadcast(dim(spark, "dim_link"))
    return slots.join(link, F.pmod(F.col("msg_id") + 5 * F.col("pos"), F.lit(17)) == F.col("k")).select(
        "msg_id", "pos", "source", "url", "anchor_text")


def message_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments: four of the five file rows carry one, the first is 'no attachment'."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"))
    file = F.broadcast(dim(spark, "dim_file"))
    return ids.join(file, F.pmod("msg_id", F.lit(SIZES["dim_file"])) == F.col("k")).where(
        F.col("filename").isNotNull()).select(
        "msg_id", F.lit(0).alias("pos"), "filename", F.unhex("content_hex").alias("content"), "declared_type")


def message_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only analyst feedback: zero, one or two rows per message."""
    from .dimensions import FEEDBACK_VERDICTS
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"))
    n = F.pmod("msg_id", F.lit(3)).cast("int")
    rows = ids.select("msg_id", F.explode(F.slice(F.array(F.lit(0), F.lit(1)), 1, n)).alias("i"))
    verdict = F.element_at(F.array(*[F.lit(v) for v in FEEDBACK_VERDICTS]),
                           (F.pmod(F.col("msg_id") + 2 * F.col("i"), F.lit(5)) + 1).cast("int"))
    return rows.select((F.col("msg_id") * 2 + F.col("i")).alias("id"), "msg_id", verdict.alias("verdict"),
                       (F.pmod(F.col("msg_id"), F.lit(4)) == 1).cast("int").alias("reviewed"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic stand-in score per message, for queries that only consume scores."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("msg_id"))
    p = F.pmod(F.col("msg_id") * 7919 + 13, F.lit(1000)) / F.lit(1000.0)
    return ids.select("msg_id", F.when(F.pmod("msg_id", F.lit(5)) != 4, p).alias("probability"),
                      F.lit(ML_THRESHOLD).alias("threshold"))


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and 0/1 truth per labelled document (truth = the quality label)."""
    labels = table(spark, sf_dir, "labels")
    return labels.selectExpr("doc_id", "quality AS y", "((pmod(doc_id * 7919 + 13, 1000) * 6 + quality * 3500) DIV 100) / 100.0D AS score")


# --------------------------------------------------------------------- oracle
CRLF = "chr(13)||chr(10)"


def _h(name, expr):
    return f"CASE WHEN {expr} IS NOT NULL THEN '{name}: '||{expr}||{CRLF} ELSE '' END"


def duck_messages() -> str:
    """The same corpus as WITH-list text for DuckDB (needs the four dimensions before it)."""
    def filled(c):
        return f"replace({c}, '{{d}}', split_part(s.address, '@', 2))"
    fold = f"replace(c.hop_top, ' by ', {CRLF}||chr(9)||'by ')"
    block = " || ".join([
        _h("Return-Path", "('<'||s.return_path||'>')"), _h("Received", fold), _h("Received", "c.hop_mid"),
        _h("Received", "c.hop_low"), _h("Authentication-Results", filled("a.auth_top")),
        _h("Authentication-Results", filled("a.auth_low")), _h("Received-SPF", "a.received_spf"),
        _h("DKIM-Signature", filled("a.dkim_signature")),
        _h("From", "('\"'||s.display_name||'\" <'||s.address||'>')"),
        f"CASE WHEN doc_id % 19 = 18 THEN 'FROM: second@other.example'||{CRLF} ELSE '' END",
        _h("Reply-To", "s.reply_to"), f"'To: analyst@example.org'||{CRLF}", _h("Subject", "l.subject"),
        _h("Date", "c.date_header"),
        f"CASE WHEN doc_id % 23 = 22 THEN '' ELSE 'Message-ID: <m'||doc_id||'@example.org>'||{CRLF} END",
        _h("X-Mailer", "s.mailer"), "'MIME-Version: 1.0'"])
    return ", ".join([duck_dim(d) for d in ("dim_sender", "dim_auth", "dim_lure", "dim_chain")] + [f"""
messages AS (
  SELECT doc_id AS msg_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 43) AS created_at,
         'doc-'||doc_id||'.eml' AS source_name, l.subject, d.text||' '||l.sentence AS text, l.html, l.label,
         {block} AS header_block
  FROM documents d JOIN dim_sender s ON d.doc_id % 11 = s.k JOIN dim_auth a ON d.doc_id % 7 = a.k
  JOIN dim_lure l ON d.doc_id % 13 = l.k JOIN dim_chain c ON d.doc_id % 3 = c.k)"""])


def duck_links() -> str:
    return duck_dim("dim_link") + """,
message_links AS (
  SELECT doc_id AS msg_id, pos, source, url, anchor_text
  FROM (SELECT doc_id, unnest(range(0, doc_id % 3 + 1)) AS pos FROM documents) d
  JOIN dim_link ON (doc_id + 5*pos) % 17 = k)"""


def duck_files() -> str:
    return duck_dim("dim_file") + """,
message_files AS (
  SELECT doc_id AS msg_id, 0 AS pos, filename, content_hex, unhex(content_hex) AS content, declared_type
  FROM documents JOIN dim_file ON doc_id % 5 = k WHERE filename IS NOT NULL)"""


def duck_feedback() -> str:
    from .dimensions import FEEDBACK_VERDICTS
    names = ", ".join(f"'{v}'" for v in FEEDBACK_VERDICTS)
    return f"""
feedback AS (
  SELECT doc_id*2 + i AS id, doc_id AS msg_id, ([{names}])[(doc_id + 2*i) % 5 + 1] AS verdict,
         CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS reviewed
  FROM (SELECT doc_id, unnest(range(0, doc_id % 3)) AS i FROM documents))"""


def duck_scores() -> str:
    return f"""
model_scores AS (
  SELECT doc_id AS msg_id, CASE WHEN doc_id % 5 <> 4 THEN ((doc_id*7919 + 13) % 1000) / 1000.0::DOUBLE END AS probability,
         {ML_THRESHOLD}::DOUBLE AS threshold FROM documents)"""


def duck_labelled_scores() -> str:
    return """
scored AS (
  SELECT doc_id, quality AS y, ((((doc_id*7919 + 13) % 1000) * 6 + quality * 3500) // 100) / 100.0::DOUBLE AS score FROM labels)"""
