"""Literal cases for headers, authentication, attachments, ingest and text."""

import io
import zipfile

from pyspark.sql import functions as F

from threatloom import dimensions as D
from threatloom.functions import attachments as A
from threatloom.functions import headers as H
from threatloom.functions import text as X
from threatloom.functions.html import inspect_html
from threatloom.functions.sqltext import q
from threatloom.operators import intents
from threatloom.sources import mail


def one(spark, expr, value, name="x"):
    return spark.createDataFrame([(value,)], f"{name} string").selectExpr(f"{expr} AS v").first()["v"]


def test_headers_unfold_and_keep_order(spark):
    block = "From alice Mon Jan 1\nReceived: a\r\n\tb\r\nSubject: Hi\nreceived: c\nbroken line\nX-Empty:"
    got = one(spark, H.header_array("x"), block)
    assert [(r["name"], r["value"]) for r in got] == [("Received", "a b"), ("Subject", "Hi"), ("received", "c"), ("X-Empty", "")]
    assert one(spark, H.split_block("x"), "not a header\n\nbody")["valid"] is False
    assert one(spark, H.split_block("x"), "A: b")["valid"] is True
    assert one(spark, H.split_block("x"), "A: b\r\n\r\nbody\n\nmore")["body"] == "body\n\nmore"


def chain(spark, values):
    df = spark.createDataFrame([(values,)], "v array<string>")
    return H.with_received_chain(df, "v").first()["hops"]


def test_received_chain(spark):
    hops = chain(spark, ["from mx.example.org by inbox.example.org; Mon, 14 Sep 2026 09:00:00 +0000",
                         "from unknown (unknown [203.0.113.77]) by mx.example.org; Mon, 14 Sep 2026 09:30:00 +0000"])
    assert hops[0]["from_ip"] == "203.0.113.77" and H.NO_RDNS in hops[0]["flags"]
    assert hops[1]["delay_seconds"] == -1800 and H.BACKWARDS in hops[1]["flags"]
    hops = chain(spark, ["from localhost (unknown [10.0.0.4]) by relay.example.org; Mon, 14 Sep 2026 09:00:00 +0000"])
    assert H.NO_RDNS not in hops[0]["flags"]
    hops = chain(spark, ["from b by c; Wed, 16 Sep 2026 09:00:00 GMT", "from a by b; 14 Sep 2026 09:00:00 +0200", "from x by a"])
    assert [h["flags"] for h in hops] == [[H.NO_TIME], [], [H.LATE]]


def auth(spark, values, received_spf=(), dkim=(), domain="x.example"):
    headers = [("Authentication-Results", v) for v in values] + [("Received-SPF", v) for v in received_spf] + [
        ("DKIM-Signature", v) for v in dkim]
    rows = [([(i, n, v) for i, (n, v) in enumerate(headers)], domain)]
    df = spark.createDataFrame(rows, "headers array<struct<pos: int, name: string, value: string>>, from_domain string")
    return H.auth_summary(df).first()


def test_authentication(spark):
    r = auth(spark, ["mx.example.org; spf=fail (not permitted) smtp.mailfrom=bad.example; dkim=none (message not signed); "
                     "dmarc=fail (p=reject) header.from=paypal.com"])
    assert (r["spf_result"], r["spf_domain"], r["dkim_result"], r["dmarc_domain"]) == ("fail", "bad.example", "none", "paypal.com")
    r = auth(spark, ["spf=none (sender IP is 57.128.69.202) smtp.mailfrom=dturm.de; dkim=none (message not signed) header.d=none;"
                     "dmarc=none action=none header.from=appjj.example.fr;compauth=fail reason=001"])
    assert (r["spf_result"], r["dmarc_domain"]) == ("none", "appjj.example.fr")
    r = auth(spark, ["mx; spf=softfail smtp.mailfrom=x.example; dmarc=temperror header.from=x.example"], dkim=["v=1; d=x.example"])
    assert (r["spf_state"], r["dmarc_state"], r["dkim_state"], r["spf_aligned"]) == ("fail", "unknown", "unknown", True)
    r = auth(spark, [])
    assert {r["spf_state"], r["dkim_state"], r["dmarc_state"]} == {"not_present"}
    r = auth(spark, ["recipient.example; dmarc=fail header.from=bank.example", "attacker.example; dmarc=pass header.from=bank.example"])
    assert r["dmarc_state"] == "fail" and r["auth_headers"] == 2
    r = auth(spark, [], received_spf=["Pass (ok) envelope-from=<a@mail.x.example>; x"])
    assert (r["spf_state"], r["spf_domain"], r["spf_aligned"]) == ("pass", "mail.x.example", True)


def zipped(*names):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n in names:
            z.writestr(n, b"x")
    return buf.getvalue()


def test_attachments(spark):
    pe = b"MZ" + b"\0" * 64
    cases = [("notes.txt", b"abc"), ("invoice.pdf.exe", pe), ("report.pdf", pe), ("macro.docm", b"PK"), ("invoice‮fdp.exe", b"x"),
             ("archive.zip", zipped("docs/readme.txt", "payload.js")), ("page.html", b"  <!DOCTYPE html>"), ("disk.iso", b"\0" * 0x8001 + b"CD001"),
             ("empty.bin", b""), ("clean.zip", zipped("a.txt"))]
    df = spark.createDataFrame([(i, 0, n, bytearray(c), "x") for i, (n, c) in enumerate(cases)],
                               "msg_id long, pos int, filename string, content binary, declared_type string")
    rows = {cases[r["msg_id"]][0]: r for r in A.analyse(df).collect()}
    ids = {k: [i["id"] for i in r["indicators"]] for k, r in rows.items()}
    assert rows["notes.txt"]["sha256"].startswith("ba7816bf") and rows["notes.txt"]["md5"] == "900150983cd24fb0d6963f7d28e17f72"
    assert ids["notes.txt"] == [] and rows["notes.txt"]["risk_rank"] == 0
    assert {"executable", "double_extension"} <= set(ids["invoice.pdf.exe"])
    assert "type_mismatch" in ids["report.pdf"] and "macro" in ids["macro.docm"] and "rtlo" in ids["invoice‮fdp.exe"]
    assert rows["archive.zip"]["archive_entries"] == ["docs/readme.txt", "payload.js"] and "archive_executable" in ids["archive.zip"]
    assert "html_attachment" in ids["page.html"] and rows["page.html"]["detected_type"] == "text/html"
    assert "disk_image" in ids["disk.iso"] and rows["disk.iso"]["detected_type"] == "application/x-iso9660-image"
    assert ids["empty.bin"] == ["empty"] and ids["clean.zip"] == ["archive"]


def test_file_names(spark):
    for raw, want in (("../../etc/passwd", "passwd"), ("..\\..\\windows\\evil.exe", "evil.exe"), ("\x07\x01", "unnamed"), ("..hidden", "hidden")):
        assert one(spark, A.sanitise_filename("x"), raw) == want


def test_html_walk(spark):
    html = ('<a href=" https://a.example ">Click <b>me</b></a><form action="/p" method="POST"><input type="Password" name="pw"></form>'
            '<div style="display: none">secret <span>words</span></div><img src="i.png"><script>x</script><iframe></iframe>'
            '<meta http-equiv="Refresh" content="0;url=x"><p hidden>gone</p>')
    r = spark.createDataFrame([(html,)], "h string").select(inspect_html("h").alias("r")).first()["r"]
    assert [(a["href"], a["text"]) for a in r["anchors"]] == [("https://a.example", "Click me")]
    assert [(f["action"], f["method"], f["password"], f["inputs"]) for f in r["forms"]] == [("/p", "post", True, ["pw"])]
    assert r["hidden"] == ["secret words", "gone"] and (r["scripts"], r["iframes"], r["images"]) == (1, 1, ["i.png"])
    assert r["refresh"] == "0;url=x" and "x" not in r["visible"].split()[:2]


MULTIPART = b"""From: a@b.example
Subject: =?utf-8?b?SGVsbG8=?=
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="b1"

--b1
Content-Type: multipart/alternative; boundary="b2"

--b2
Content-Type: text/plain; charset=utf-8
Content-Transfer-Encoding: base64

R3Jvw58=
--b2
Content-Type: text/html

<p>Hi</p>
--b2--
--b1
Content-Type: application/pdf; name="f.pdf"
Content-Disposition: attachment; filename="f.pdf"

data
--b1--
"""


def test_scan_and_ingest(spark, tmp_path):
    for label, source, name, data in (("phishing", "phishing_pot", "sub/a.eml", MULTIPART), ("phishing", "phishing_pot", "big.eml", b"A: b\n\n" + b"x" * 5000),
                                      ("phishing", "phishing_pot", "skip.txt", b"A: b"), ("legitimate", "spamassassin_ham", "h.txt", b"Subject: ham\n\nbody")):
        path = tmp_path / label / source / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    raw = mail.scan(spark, str(tmp_path), max_bytes=4000)
    assert sorted((r["label"], r["path"].rsplit("/", 1)[1]) for r in raw.collect()) == [("legitimate", "h.txt"), ("phishing", "a.eml")]
    rows = {r["label"]: r for r in mail.ingest(raw, "label").collect()}
    got = rows["phishing"]
    assert got["subject"] == "Hello" and got["plain"].strip() == "Groß" and got["html"].strip() == "<p>Hi</p>" and got["parse_error"] is None
    assert [(a["filename"], a["content_type"]) for a in got["attachments"]] == [("f.pdf", "application/pdf")]
    assert [p["path"] for p in got["parts"]] == ["1", "1.1", "1.1.1", "1.1.2", "1.2"]
    assert rows["legitimate"]["plain"] == "body"
    assert mail.registered_sources(spark, raw).count() == 2


def test_broken_mail_does_not_fail(spark):
    rows = [(1, bytearray(b"\xff\xfe\x00garbage")), (2, bytearray(b"Content-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain; charset=nope\n\nhi"))]
    got = {r["k"]: r for r in mail.ingest(spark.createDataFrame(rows, "k int, content binary"), "k").collect()}
    assert got[1]["parse_error"] is None and got[2]["plain"].strip() == "hi" and got[2]["warnings"]


def test_normalise(spark):
    body = "Visit https://evil.example/login now\nOn Monday Bob wrote:\n> quoted\nFrom: x\nMail a.b@c.example pay 1,234.50\n-- \nsig"
    got = spark.createDataFrame([("Re: Fwd: [team] Hello", body)], "s string, b string").selectExpr(f"{X.normalise('s', 'b')} AS t").first()["t"]
    assert "urltoken" in got and "emailtoken" in got and " 0" in got and "evil" not in got and "quoted" not in got
    assert "sig" not in got and "wrote" not in got and not got.startswith("re") and "team" not in got


def test_english(spark):
    assert one(spark, X.is_english("x"), "please verify that you have the account and the password for this") is True
    assert one(spark, X.is_english("x"), "bitte bestätigen sie ihr konto und das passwort sofort heute noch") is False
    assert one(spark, X.is_english("x"), "the and to") is False


def test_clean_line_defang_entropy(spark):
    assert one(spark, X.clean_line("x", 5), "a\x00 b\n\nc d e") == "a b c…"
    assert one(spark, X.defang("x"), "HTTP://a.b.example") == "hxxp://a[.]b[.]example"
    assert abs(one(spark, X.entropy_bits("x"), "aabb") - 1.0) < 1e-9 and one(spark, X.entropy_bits("x"), "") == 0.0


def test_char_grams(spark):
    assert one(spark, X.char_wb_grams("x", [5]), "ab hello") == [" ab ", " hell", "hello", "ello "]
    assert one(spark, X.char_wb_grams("x", [3, 4, 5]), "a") == [" a "]
    assert one(spark, X.char_wb_grams("x", [3, 4, 5]), "ab") == [" ab", "ab ", " ab "]


def test_phrases_look_one_way_at_their_ends_and_need_their_words(spark):
    """The plain boundary, taken at every end, finds the same; texts that match pass the test that saves the search."""
    old = [(i, k, "(?i)" + p.replace(r"\b", X._BOUNDARY), "(?i)" + X.ascii_words(p)) for i, (_, ps) in D.INTENTS.items() for k, (p, _) in enumerate(ps)]
    assert sum(X._BOUNDARY in new for *_, new in old) <= 3
    rows = ["the code is one you can do today", "verify your password", "Pre-enter your pin.", "xverify your email", "DO NOT share it", "\u00e9share the OTP\u00e9",
            "pay this big fee", "pay this fees", "within 3 hours_", "within the next 12 HRS", "it support", "exit support", "$5 gift cards", "you have won", "has been locked",
            "new bank details", "customs duty", "the invoice is 3 days overdue", "final notice", "send me the codes"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for i, k, a, b in old:
        got = df.selectExpr(f"regexp_extract_all(t, {q(a)}, 0) AS a", f"regexp_extract_all(t, {q(b)}, 0) AS b", f"{intents.may_hold('lower(t)', i, k)} AS may").collect()
        assert all(r["a"] == r["b"] and (r["may"] or not r["a"]) for r in got), (i, k)
    # Words that stand in most texts do not start a search by themselves.
    assert df.selectExpr(f"count_if({intents.may_hold('lower(t)', 'mfa_request', 1)}) AS n").first()["n"] <= 2


def test_phrases_look_at_their_first_letter_first(spark):
    """Searches end at most places after one table look; what they find is what a written class and no look find."""
    cls = "[A-Za-z0-9_]"
    plain = f"(?:(?<={cls})(?!{cls})|(?<!{cls})(?={cls}))"
    phrases = [p for _, ps in D.INTENTS.values() for p, _ in ps]
    made = [X.ascii_words(p) for p in phrases]
    assert sum(m.startswith("(?=[") for m in made) >= len(made) - 2 and not any("A-Z" in m for m in made)
    assert X.ascii_words(r"\b(?:re-?enter|act (?:now|on))\b") == r"(?=[ARar])(?<!\w)(?:re-?enter|act (?:now|on))(?!\w)"
    assert X.ascii_words(r"\ba?sap\b").startswith(X._BOUNDARY)
    rows = ["KEEP this quiet", "Keep this quiet", "ékeep it private", "keep it privateé", "_keep it private", "re-enter your pin and re-register your MFA", "ſign in here",
            "Sign in here", "Act now, asap. ASAP_ 1asap", "Wire transfer, late FEES", "irs İrs IRS", "You've won; you HAVE been selected", "Part-time job: work from home", None, ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for p, m in zip(phrases, made):
        old = "(?i)" + p.replace(r"\b", plain)
        assert df.where(f"NOT regexp_extract_all(t, {q(old)}, 0) <=> regexp_extract_all(t, {q('(?i)' + m)}, 0)").isEmpty(), p
