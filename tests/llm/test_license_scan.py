import re

from threatloom.llm import license_scan as L


def plain(text):
    """Base columns from the word list."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for phrase, label in L.BASE:
        want = phrase.decode().split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(want)] == want]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_query_against_word_lists(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op4_scan_licenses(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[1:6]) == plain(texts[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert any(r["n_base"] for r in rows)


def test_edges(spark):
    texts = [None, "", "CC-BY cc by\tcc  BY", "mit licenseé mit license", "MIT LICENSE!mit/license gnu general public license apache license",
             "mit license " * 40_000, "x" * 500_000]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(0, None, "n")], "doc_id int, text string, labels string")
    rows = L.scan_licenses(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert tuple(r[1:6]) == plain(texts[r["doc_id"]] or "")
    assert L.scan_licenses(docs.limit(0)).count() == 0


def labels(text):
    words = b" ".join(text.encode().translate(L.FOLD).split())
    return {d[3] for d in L.uncontained(L.Scanner().detections(words))}, L.uncontained(L.Scanner().detections(words))


def test_rules_and_suppression():
    assert len(L.rules()) > 300
    assert labels("Licensed under the GNU Lesser General Public License, version 2.1 or later")[0] == {"lgpl"}
    assert labels("SPDX-License-Identifier: Apache-2.0")[0] == {"apache"}
    assert labels("Creative Commons Attribution-ShareAlike 4.0")[0] == {"cc-by-sa"}
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this software")[0] == {"mit"}
    assert labels("mit einer Lizenz und der Apache ist da")[0] == set()
    kept = labels("released under the terms of the Mozilla Public License 2.0")[1]
    assert [d[2] for d in kept] == [L.VERSIONED]


def test_containment_against_all_pairs():
    found = [(0, 10, 1, "a"), (2, 5, 2, "b"), (3, 4, 2, "c"), (0, 10, 1, "d"), (0, 12, 1, "e"), (5, 12, 3, "f"), (11, 20, 1, "g"), (11, 20, 5, "h")]
    got = L.uncontained(found)
    for d in found:
        inside = [e for e in found if e[:2] != d[:2] and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]]
        better = [e for e in found if e[:2] == d[:2] and (e[2] > d[2] or e[2] == d[2] and e[3] < d[3])]
        assert (d in got) == (not inside and not better), d


def test_names_pass_their_own_prefilter():
    scanner = L.Scanner()
    for label, _, full, _, versions, _, _ in L.FAMILIES:
        name = full.replace("licen[sc]e", "license").replace("(?: ", " ").replace(")?", "").replace("?", "").replace("(ative)s", "s").replace("(?:", "").replace("ative)?s", "s")
        if "(" not in name and ")" not in name and name not in ("w3c software notice and license",):
            found = {d[3] for d in scanner.detections(name.encode())}
            assert label in found, (label, name)
