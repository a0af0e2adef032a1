"""Intents, scoring invariants and whole investigations."""

import math

import pytest
from pyspark.sql import functions as F

from threatloom import dimensions as D
from threatloom import fixtures as fx
from threatloom.operators import intents, results, scoring
from threatloom.plans.analysis import investigate


def scored_intents(spark, text, subject="", cta=True):
    df = intents.raw_scores(spark.createDataFrame([(1, text, subject, cta)], "msg_id long, text string, subject string, call_to_action boolean"))
    return intents.in_context(df).first()


PHISH = "Your account will be suspended within 24 hours unless you verify your credentials immediately."


def test_intents_amplify(spark):
    r = scored_intents(spark, PHISH)
    assert r["raw_account_threat"] > 0 and r["score_credential_request"] > r["raw_credential_request"] > 0
    r = scored_intents(spark, "Limited time: 20% off this week only. Hurry, sale expires Sunday!")
    assert r["score_urgency"] < r["raw_urgency"] and r["raw_credential_request"] == 0
    r = scored_intents(spark, "Are you at your desk? I need you to buy four gift cards and send me the codes. Keep this confidential.", cta=False)
    assert r["raw_gift_card"] > 0 and r["raw_secrecy"] > 0
    r = scored_intents(spark, "Hi team, the meeting notes from Tuesday are attached. See you at lunch.", "notes", False)
    assert all(r[f"raw_{i}"] == 0 for i in D.INTENTS)
    assert scored_intents(spark, "nothing", "Final notice: act now")["raw_urgency"] == pytest.approx(2.2)


def test_overlapping_phrases_count_once(spark):
    r = scored_intents(spark, "Please verify your identity.")
    assert r["raw_credential_request"] == 2.0


def test_masking_agrees_with_spans(spark, sf):
    """The masked chain and the exact first-come fold give the same scores on every message."""
    import re
    m = fx.messages(spark, sf).select("msg_id", "text", F.lit("").alias("subject"))
    found = {(r["msg_id"], r["intent"]): r["n"] for r in intents.spans_of(m).groupBy("msg_id", "intent").agg(F.count("*").alias("n")).collect()}
    for r in intents.raw_scores(m).collect():
        for i, (_, phrases) in D.INTENTS.items():
            taken, want = [], 0.0
            for p, w in phrases:
                spans = [x.span() for x in re.finditer(p, r["text"], re.I | re.A) if x.group().strip()]
                fresh = []
                for a, b in spans:
                    if not any(a < e and b > s for s, e in taken):
                        taken.append((a, b))
                        fresh.append((a, b))
                want += w if fresh else 0
            assert r[f"raw_{i}"] == pytest.approx(want), (r["msg_id"], i)
            assert found.get((r["msg_id"], i), 0) == len(taken)


def test_spans_index_into_the_text(spark):
    df = spark.createDataFrame([(1, "😀 " + PHISH)], "msg_id long, text string")
    spans = intents.spans_of(df).join(df, "msg_id").selectExpr("quote", "substring(text, start + 1, end - start) AS cut").collect()
    assert spans and all(r["quote"] == r["cut"] for r in spans)


FACTS = {
    "from_org": "example.org", "sender_brand": None, "dmarc_state": "pass", "dmarc_aligned": True, "password_forms": 0,
    "probability": None, "threshold": 0.5, "model_confidence": "high",
}


def verdict(spark, findings, trusted=False, **over):
    """Score one row of hand-made findings: (detector, category, severity, confidence, group)."""
    row = {**FACTS, "dmarc_state": "pass" if trusted else "fail", **over}
    cols = ["findings", "from_org", "sender_brand", "dmarc_state", "dmarc_aligned", "password_forms", "probability", "threshold", "model_confidence"]
    fs = [(d, c, s, float(k), d, g, []) for d, c, s, k, g in findings]
    schema = ("findings array<struct<detector: string, category: string, severity: string, confidence: double, title: string, score_group: string, "
              "evidence: array<string>>>, from_org string, sender_brand string, dmarc_state string, dmarc_aligned boolean, password_forms int, "
              "probability double, threshold double, model_confidence string")
    df = spark.createDataFrame([tuple([fs] + [row[c] for c in cols[1:]])], schema)
    df = df.selectExpr("*", "CAST(NULL AS struct<confidence: double>) AS sender_lookalike",
                       "from_json('[]', 'array<struct<source: string, registrable: string, brand: string, risk_rank: int>>') AS links",
                       "from_json('[]', 'array<struct<risk_rank: int>>') AS files")
    return scoring.score(df).first()


def test_bands(spark):
    rows = spark.range(101).selectExpr("int(id) AS s").selectExpr("s", f"{scoring.level_of('s')} AS l", f"{scoring.class_of('s')} AS c").collect()
    assert [rows[i]["l"] for i in (19, 20, 40, 60, 80)] == ["safe", "low", "medium", "high", "critical"]
    assert [rows[i]["c"] for i in (34, 35, 59, 60)] == ["legitimate", "suspicious", "suspicious", "phishing"]


def test_nothing_found_is_safe(spark):
    r = verdict(spark, [])
    assert (r["risk_score"], r["risk_level"], r["classification"]) == (0, "safe", "legitimate") and "ML" not in r["summary"]


def test_group_cap_and_decay(spark):
    one = verdict(spark, [("url.x", "url", "high", 0.5, "url")])["rule_score"]
    two = verdict(spark, [("url.x", "url", "high", 0.5, "url")] * 2)["rule_score"]
    many = verdict(spark, [("url.x", "url", "high", 0.9, "url")] * 12)["rule_score"]
    assert one == 11.0 and two == 16.5 and many <= D.GROUP_CAPS["url"]
    assert verdict(spark, [("x", "y", "critical", 1.0, "unheard_of")])["rule_score"] == D.DEFAULT_GROUP_CAP


def test_critical_floor(spark):
    r = verdict(spark, [("url.credential_harvesting", "url", "critical", 0.97, "credential_form")])
    assert r["risk_score"] >= 60 and r["classification"] == "phishing"
    assert "Critical indicator floor" in [c["label"] for c in r["contributions"]]
    assert verdict(spark, [("x", "url", "critical", 0.85, "url")])["risk_score"] < 60


def test_model_alone_cannot_decide(spark):
    r = verdict(spark, [], probability=0.999)
    assert r["classification"] == "legitimate" and r["raw_points"] <= 8
    low = verdict(spark, [("a", "header", "medium", 1.0, "header")] * 2, probability=0.9, model_confidence="low")["raw_points"]
    high = verdict(spark, [("a", "header", "medium", 1.0, "header")] * 2, probability=0.9)["raw_points"]
    assert low < high
    assert verdict(spark, [("a", "sender", "high", 1.0, "sender")], probability=0.01)["raw_points"] < 22


def test_corroboration(spark):
    cats = ["url", "sender", "authentication", "attachment"]
    three = verdict(spark, [(c, c, "high", 0.5, c) for c in cats[:3]])
    four = verdict(spark, [(c, c, "high", 0.5, c) for c in cats])
    assert three["raw_points"] - three["rule_score"] == 8 and four["raw_points"] - four["rule_score"] == 12


def test_trust_downgrade(spark):
    fs = [("content.credential_request", "content", "high", 0.8, "content"), ("content.financial_request", "content", "high", 0.8, "content"),
          ("url.ip_host", "url", "high", 0.9, "url")]
    r = verdict(spark, fs, trusted=True)
    assert [f["severity"] for f in r["findings"]] == ["low", "high", "high"] and r["findings"][0]["adjusted_from"] == "high"
    assert [f["severity"] for f in verdict(spark, fs)["findings"]] == ["high"] * 3
    assert verdict(spark, fs, dmarc_state="pass", dmarc_aligned=None)["trusted"] and not verdict(spark, fs, dmarc_state="pass", dmarc_aligned=False)["trusted"]


def test_saturation_is_monotone(spark):
    scores = [verdict(spark, [(f"d{i}", "header", "medium", 0.9, g) for i, g in enumerate(list(D.GROUP_CAPS)[:n])])["risk_score"] for n in (1, 3, 6, 9)]
    assert scores == sorted(scores) and scores[-1] < 100
    assert math.isclose(100 * (1 - math.exp(-1)), 63.2, abs_tol=0.1)


def header_block(sender, auth, subject, reply=None, chain=0):
    head = [f"Received: {h}" for h in fx.DIM_CHAIN[1][chain][2:] if h]
    head += [f"Authentication-Results: {auth}"] if auth else []
    head += [f"From: {sender}"] + ([f"Reply-To: {reply}"] if reply else [])
    return "\r\n".join(head + [f"Subject: {subject}", "Date: " + fx.DIM_CHAIN[1][chain][1], "Message-ID: <x@y>"])


def passing(domain):
    return f"mx; spf=pass smtp.mailfrom={domain}; dkim=pass header.d={domain}; dmarc=pass header.from={domain}"


@pytest.fixture(scope="module")
def samples(spark):
    """Hand-made messages, investigated together."""
    cases = {
        "account": (header_block('"Microsoft account team" <security@micr0soft-accountprotection.com>', "mx; spf=fail smtp.mailfrom=x.top; dmarc=fail",
                                 "Unusual sign-in activity", "help@mail-verify.top", 1), "Unusual sign-in activity", PHISH,
                    [("anchor", "https://login.micr0soft-accountprotection.com/verify", "https://account.microsoft.com")], []),
        "invoice": (header_block('"Supplier" <billing@supplier.example>', None, "Invoice"), "Invoice",
                    "Our bank details have been changed, please process the payment today.", [("text", "http://203.0.113.9/inv", None)],
                    [("Invoice.pdf.exe", b"MZ\0\0")]),
        "executive": (header_block('"James Porter, CEO" <ceo@example.org>', passing("example.org"), "Quick favour", "boss@gmail.com"), "Quick favour",
                      "Are you available? Buy some gift cards today and keep this confidential. Sent from my iPhone", [], []),
        "homoglyph": (header_block('"Apple" <id@xn--pple-43d.com>', passing("xn--pple-43d.com"), "Apple ID"), "Apple ID", "Confirm your account.",
                      [("anchor", "https://xn--pple-43d.com/id", "Apple ID")], []),
        "reset": (header_block('"Northwind" <no-reply@northwind.example>', passing("northwind.example"), "Reset your password"), "Reset your password",
                  "We received a request to reset your password. Verify your email within 24 hours.",
                  [("anchor", "https://northwind.example/password_reset/abc", "Reset password")], []),
        "notice": (header_block('"Google" <no-reply@accounts.google.com>', passing("accounts.google.com"), "Security alert"), "Security alert",
                   "A new sign-in on your account.", [("anchor", "https://accounts.google.com/x?continue=https://mail.google.com/", "Check activity"),
                                                       ("image", "https://www.gstatic.com/a.png", None)], []),
        "newsletter": (header_block('"Shop" <news@shop.example>', passing("shop.example"), "Summer sale"), "Summer sale",
                       "Limited time: 20% off this week only.", [("anchor", "https://shop.example/sale", "Shop now")], []),
    }
    names = list(cases)
    m = spark.createDataFrame([(i, cases[n][0], cases[n][1], cases[n][2], None, "m.eml", n) for i, n in enumerate(names)],
                              "msg_id long, header_block string, subject string, text string, html string, source_name string, label string").withColumn(
        "created_at", F.expr("timestamp'2024-01-01 10:00:00'"))
    link = spark.createDataFrame([(i, k, *x) for i, n in enumerate(names) for k, x in enumerate(cases[n][3])],
                                 "msg_id long, pos int, source string, url string, anchor_text string")
    file = spark.createDataFrame([(i, k, f, bytearray(c), "x") for i, n in enumerate(names) for k, (f, c) in enumerate(cases[n][4])],
                                 "msg_id long, pos int, filename string, content binary, declared_type string")
    score = spark.createDataFrame([(i, None, 0.5) for i in range(len(names))], "msg_id long, probability double, threshold double")
    return {r["label"]: r for r in investigate(m, link, file, score).collect()}


@pytest.mark.parametrize("name,detectors", [
    ("account", {"auth.dmarc", "impersonation.display_name", "impersonation.lookalike_sender", "url.anchor_mismatch", "header.reply_to_mismatch",
                 "content.credential_request"}),
    ("invoice", {"attachment.disguised_name", "url.ip_host"}), ("executive", {"impersonation.executive"}), ("homoglyph", {"impersonation.homoglyph"})])
def test_phishing_samples(samples, name, detectors):
    assert samples[name]["classification"] == "phishing"
    assert detectors <= {f["detector"] for f in samples[name]["findings"]}


@pytest.mark.parametrize("name", ["reset", "notice", "newsletter"])
def test_legitimate_samples(samples, name):
    assert samples[name]["classification"] == "legitimate" and samples[name]["trusted"]


def test_segments(spark):
    texts = spark.createDataFrame([(1, 20), (2, 5)], "msg_id long, length int")
    spans = spark.createDataFrame([(1, "a", 2, 8), (1, "b", 5, 10), (1, "c", 15, 30)], "msg_id long, intent string, start int, end int")
    got = [tuple(r) for r in results.evidence_segments(texts, spans).orderBy("msg_id", "start").collect()]
    assert got == [(1, 0, 2, ""), (1, 2, 5, "a"), (1, 5, 8, "a,b"), (1, 8, 10, "b"), (1, 10, 20, ""), (2, 0, 5, "")]


def test_occurrences(spark):
    t = spark.createDataFrame([(1, "a.b", "x a.b y a.b"), (2, "a.b", "axb")], "msg_id long, url string, text string")
    assert [(r["start"], r["end"]) for r in results.occurrences(t).orderBy("start").collect()] == [(2, 5), (8, 11)]


def test_refused_parameters(spark):
    v = spark.createDataFrame([(1, "high", "phishing")], "msg_id long, risk_level string, classification string")
    with pytest.raises(ValueError):
        results.facets(v, levels=["awful"])
    with pytest.raises(ValueError):
        results.page(v, sort="msg_id; drop")
    assert results.facets(v).count() == 1
