import hashlib
import re

import numpy as np
import pytest

from threatloom.llm import personal_data as P

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    """The four patterns as they are written, with their checks."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = ["", "no data", "a@b.c@d.e x%y@z.q.r", "a@b@c.d", "@x.y z@.com q@w.", "é.x@ñ.com a+b@c-d.e.f", "1.2.3.4.5 01.002.0255.9 256.1.1.1 1.1.1.1.1.1.1.1",
         "4041894974608795 4041 8949-7460 8795 4041894974608796 4111111111111111", "+1 (456) 555-2186 +12 +1 2 +123456789012345678 +1234567",
         "x" * 3000 + "@" + "y" * 50 + ".z", "1" * 40 + "." + "2.3.4", "a@b.c%d@e.f", "+1 222 333 4444. +44(20)1234-5678-", "aa@bb.cc@", "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_are_those_of_the_patterns(text):
    assert [f"{k}:{a}:{b}" for k, spans in zip(P.BASE, P.base_spans(text)) for a, b in spans] == plain(text)


def test_long_runs_stay_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "1 " * 200_000, "a1-" * 100_000):
        P.candidates(text, P.base_spans(text))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = P.op10_personal_data(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    added = 0
    for r in rows:
        spans = plain(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.BASE] == [sum(s.startswith(k + ":") for s in spans) for k in P.BASE]
        every = [s for s in r["spans"].split(",") if s]
        assert set(spans) <= set(every)
        order = [(P.KINDS.index(k), int(a)) for k, a, b in (s.split(":") for s in every)]
        assert order == sorted(order)
        added += len(every) - len(spans)
    assert added > 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a@b.cc", "y"), (1, "", "z"), (1, "", "z"), (2, "w " * 50_000 + "+1 222 333 4444", "z")],
                                 "doc_id int, text string, spans string")
    rows = {(r["doc_id"], r["n_email"], r["n_phone"], r["spans"].split(":")[0]) for r in P.find_personal_data(docs).collect()}
    assert rows == {(1, 0, 0, ""), (None, 1, 0, "email"), (2, 0, 1, "phone")}
    assert P.find_personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["write to john at example dot org", "write to john (at) example (dot) org", "write to john (AT) example dot org"])
def test_spelled_addresses_are_candidates(text):
    assert ("address", 9, len(text)) in [c[:3] for c in P.candidates(text, P.base_spans(text))]


def test_fitting_reads_every_document(spark, monkeypatch):
    """All candidates are learnt from or held out, those of texts without a digit or an @ too."""
    tables, kept = [], P.checkpointed

    def seen(df):
        out = kept(df)
        tables.append(out)
        return out
    monkeypatch.setattr(P, "checkpointed", seen)
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE id % 3 WHEN 0 THEN concat('mail a', id, '@b.cc now') WHEN 1 THEN concat('order 123456', id) "
                                        "ELSE 'password: swordfish' END AS text")
    assert P.fit(docs) is not None
    assert tables[0].count() >= 6000


def test_threshold_is_the_lowest_with_the_wanted_precision(spark):
    rng = np.random.default_rng(5)
    score = np.round(rng.random(3000), 3)
    label = (rng.random(3000) < score).astype(int)
    df = spark.createDataFrame(list(zip(score.tolist(), label.tolist())), "score double, label int")
    for precision in (0.6, 0.9, 0.97):
        want = [s for s in np.unique(score) if label[score >= s].mean() >= precision]
        assert P.lowest(df, precision) == (min(want) if want else None)
    assert P.lowest(df.where("label = 0"), 0.5) is None
