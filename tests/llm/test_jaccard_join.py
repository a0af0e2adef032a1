import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.llm import jaccard_join as J


def plain(rows):
    """n_shingles and component of every row by all pairs of sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(rows)
    near = [[j for j in range(n) if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out.append((rows[i][0], len(sets[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)))
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    passage, rows = word(60), []
    for _ in range(6):
        base = word(int(rng.integers(40, 250)))
        family = [base]
        for _ in range(25):  # copies of copies, changed a little or much
            t = list(family[rng.integers(0, len(family))])
            for k in rng.integers(0, len(t), int(rng.choice([0, 1, 2, 4, 9]))):
                t[k] = "new" + str(rng.integers(0, 10**6))
            family.append(t[:int(rng.integers(len(t) * 3 // 4, len(t) + 1))])
        rows += family
    rows += [passage + word(int(rng.integers(5, 60))) for _ in range(60)] + [word(5) for _ in range(5)]
    texts = [" ".join(t) for t in rows] + ["", None, " \t ", "a b c", "A\nB c", "a b", "x y z u v", "X y  z u v w"]
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("frequent, limit, tile", [(16, 500_000, 256), (4, 500_000, 10), (4, 0, 4)])
def test_against_all_pairs(spark, monkeypatch, frequent, limit, tile):
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "FREQUENT", frequent)
    monkeypatch.setattr(J, "BROADCAST_IDS", limit)
    rows = corpus()
    rows += [rows[3], rows[30], (None, rows[5][1]), (None, "alone and without an id in here"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, n_shingles int").repartition(6)
    assert sorted(map(tuple, J.linked(docs).collect()), key=repr) == plain(rows)


def test_stage_keeps_one_of_each(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, component_id string")
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in plain(rows) if i == c)


def test_empty_and_small(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.linked(docs).count() == 0
    one = spark.createDataFrame([(4, "a b"), (2, "a b"), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, J.linked(one).collect())) == [(2, 1, 2), (3, 0, 3), (4, 1, 2)]


def test_fragments_sum_to_the_overlap(spark):
    sets = spark.createDataFrame([(1, 7, [-9, -1, 0, 5, 1 << 61, 1 << 62, -(1 << 62)]), (2, 7, [-9, -1, 0, 5, 1 << 61, 1 << 62, 8]), (3, 7, [-9, 1, 2, 3, 4, 6, 7])],
                                 "id long, n long, hashes array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 2)], "a long, b long")
    assert [tuple(r) for r in J.verified(pairs, sets, 75, 100).select("a", F.col("b")).collect()] == [(1, 2)]


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 900, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, int(n), replace=False)) for n in rng.integers(1, 880, 60)]
    sets += [s[:max(1, len(s) * 9 // 10)] for s in sets[:30]] + [sets[0]]
    counts = np.array([len(s) for s in sets])
    bits, words = J.bitmaps(np.concatenate(sets), counts)
    assert all(64 * w >= J.BITS * n and w & (w - 1) == 0 for w, n in zip(words.tolist(), counts.tolist()))
    each = [b.tobytes() for b in np.split(bits, np.cumsum(words)[:-1])]
    rows = J.pa.array([{"id": i, "n": int(n), "part": i, "bits": b} for i, (n, b) in enumerate(zip(counts, each))])
    tile = J.Sketches(rows)
    may = J.possible(tile, tile, 75, 100)
    links = np.array([[100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y)) for y in sets] for x in sets])
    np.fill_diagonal(links, False)
    assert links.sum() >= 60 and not (links & ~may).any()
    assert may.sum() < links.size // 4  # it leaves most pairs out


def test_no_join_of_a_growing_table_is_a_broadcast(spark, monkeypatch):
    plans, kept = [], J.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)
    monkeypatch.setattr(J, "checkpointed", seen)
    monkeypatch.setattr(J, "membership", lambda rows, ids, how: rows.join(ids.hint("merge"), ids.columns, how))  # bounded by its count
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z {i % 7}") for i in range(60)], "doc_id long, text string")
    got = J.linked(docs)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert {r["component_id"] for r in got.collect()} == {0}
    assert not any("BroadcastHashJoin" in p for p in plans)
