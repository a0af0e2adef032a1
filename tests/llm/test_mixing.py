import hashlib
import re
from collections import defaultdict

from threatloom.llm import mixing as M


def plain(rows, weights=(5, 2, 1), share=1.5, copies=2):
    """(size, source_size, target, taken) of every row, with sorting."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    keys = [int(hashlib.md5((str(i) if i is not None else "t" + (t or "")).encode()).hexdigest()[:15], 16) for i, t, _ in rows]
    total = defaultdict(int)
    for n, (_, _, s) in zip(sizes, rows):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, budget = {}, set(order), share * sum(sizes)
    while open_:  # give by weight; what is above its limit stops there, the rest is shared again
        per = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if per * weight[s] >= copies * total[s]}
        target |= {s: copies * total[s] for s in full} if full else {s: per * weight[s] for s in open_}
        budget -= sum(copies * total[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in order:
        mine = sorted((k, n) for k, n, r in zip(keys, sizes, rows) if r[2] == s)
        base = min(copies, int(target[s] // max(1, total[s])))
        need, got, taken = target[s] - base * total[s], 0, set()
        for k in sorted({k for k, _ in mine}):
            n = sum(x for j, x in mine if j == k)
            if need > got and (got + n < need or (need - got) * 2 >= n):
                taken.add(k)
            got += n
        out += [(n, total[s], round(target[s], 6), n * (base + (k in taken))) for k, n, r in zip(keys, sizes, rows) if r[2] == s]
    return sorted(out)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, size int")
    return sorted((r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in M.mix(docs, **more).collect()), docs


def test_against_sorting(spark):
    rows = [(i, "w " * (i * 7 % 40), "abcde"[i % 5] if i % 3 else "a") for i in range(400)] + [(500 + i, "x y", None) for i in range(9)]
    rows += [(600, "long " * 30_000, "b"), (None, "no id here", "c"), (None, None, "c"), (601, "", "empty"), (0, "w " * 5, "a")]
    got, docs = run(spark, rows)
    assert got == plain(rows)
    assert run(spark, rows, levels=(2, 3, 55))[0] == got
    taken = M.mixed_rows(docs)
    assert taken.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in taken.collect()) == sum(r[3] for r in got)


def test_empty_and_wordless(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(1, "", "a"), (2, None, None)])[0] == [(0, 0, 0.0, 0)] * 2
