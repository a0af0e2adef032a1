import re

import numpy as np

from threatloom.llm import decontamination as D
from threatloom.llm.words import FOLD, FOLD_SPACE, shingles


def plain(text, size=5, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", short=False):
    w = re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < size:
        return {tuple(w)} if short and w else set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def test_shingle_counts_and_equality():
    texts = ["", " ", "a b", "A  b", "a b c d e", "a b c d e f a b c d e", "é ü ñ ç à ß", "x,y;z x y z x y z", "\t\x0b\x1ca\x85b", "long " * 5000]
    for fold, pattern in ((FOLD, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (FOLD_SPACE, r"[^\x20\x09-\x0D]+")):
        for short in (True, False):
            hashes, counts = shingles([t.encode() for t in texts], fold, 5, short)
            sets = [plain(t, 5, pattern, short) for t in texts]
            assert counts.tolist() == [len(s) for s in sets]
            parts = np.split(hashes, np.cumsum(counts)[:-1])
            for a in range(len(texts)):
                for b in range(len(texts)):
                    assert len(set(parts[a]) & set(parts[b])) == len(sets[a] & sets[b])


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 4000, n))
    items = [word(n) for n in (5, 6, 9, 14, 30, 60, 200)] + ["one two three", "", None]
    docs = []
    for i in items[:7]:
        w = i.split()
        for lost in (0, 1, 2, 3):
            cut = list(w)
            for k in rng.integers(0, len(w), lost):
                cut[k] = "changed"
            docs.append(word(300) + " " + ", ".join(cut).upper() + ". " + word(300))
    docs += [None, "", "one two three", word(60_000), items[4], items[4]]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)] + [(0, docs[0], 1)], "doc_id int, text string, n_found int")
    b = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = []
    for i, t in [*enumerate(docs), (0, docs[0])]:
        for j, u in enumerate(items):
            x, y = plain(t), plain(u)
            if y and len(x & y) >= 0.75 * len(y):
                want.append((i, j, len(y), len(x & y)))
    got = sorted(tuple(r)[:4] for r in D.contained(d, b).collect())
    assert got == sorted(want)
    small = [D.Block(s, 0.75) for s in ([],)]
    assert not len(small[0].found(np.zeros(3, np.uint64), np.arange(3))[0])
    clean = D.without_items(d, b)
    assert clean.columns == d.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, t in [*enumerate(docs), (0, docs[0])] if i not in {w[0] for w in want})
    assert D.contained(d, b.limit(0)).count() == 0 and D.contained(d.limit(0), b).count() == 0


def test_blocks_give_the_same_rows(spark, sf, monkeypatch):
    whole = sorted(map(tuple, D.op8_decontaminate(spark, sf).collect()))
    monkeypatch.setattr(D.blocks, "__defaults__", (0.75, 5, 300))
    assert sorted(map(tuple, D.op8_decontaminate(spark, sf).collect())) == whole and whole
