import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threatloom.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<double>, label int, score double, d int"


def plain(rows, every=100, k=5):
    """All scores of all anchors, in Python's whole numbers."""
    usable = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
              if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, u, y in usable:
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(u, v)), i, z) for i, v, z in usable if len(v) == len(u)]
        for s, i, _ in sorted(x for x in scores if x[2] == y and x[1] != a)[:k]:
            fits = sorted(x for x in scores if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s)
            out += [(a, i, r, n, -s, -t) for r, (t, n, _) in enumerate(fits[:k], 1)]
    return sorted(out)


def mined(spark, rows, every=100, **more):
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0, **more).collect())


def clustered(n, d, seed, kinds=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(kinds, d))
    rows = centers[rng.integers(0, kinds, n)] + rng.normal(size=(n, d)) * 0.5
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    return [(i, v, int(y)) for i, (v, y) in enumerate(zip(rows.tolist(), rng.integers(0, kinds, n)))]


def test_join_against_all_pairs():
    rng = np.random.default_rng(7)
    for d in (1, 5, 16, 40):
        for t in (-10 ** 6, 0, 500, 4000, 10 ** 6):
            y, a = (np.floor(rng.normal(size=(n, d)) * 64 * rng.random((n, 1))) for n in (200, 30))
            low = np.array([t + 37 * i for i in range(30)], dtype=np.int64)
            rows, anchors, scores = H.threshold_join(y, H.suffix_norms(y), a, H.suffix_norms(a), low)
            every = (y @ a.T).astype(np.int64)
            assert sorted(zip(rows, anchors, scores)) == [(i, j, every[i, j]) for i in range(200) for j in range(30) if every[i, j] >= low[j]]


@pytest.mark.parametrize("sample", [0, 1, 50, 2048])
def test_thresholds_do_not_change_results(spark, sample):
    rows = clustered(500, 12, sample)
    assert mined(spark, rows, 50, sample_rows=sample) == plain(rows, 50)


def test_blocks_of_anchors(spark):
    rows = clustered(400, 9, 3)
    assert mined(spark, rows, 20, anchor_bytes=500) == plain(rows, 20)


def test_ties_copies_and_short_windows(spark):
    random.seed(2)
    rows = [(i, [0.25, 0.5], i % 3) for i in range(40)] + [(100 + i, [random.choice([0.0, 0.25, -0.5]) for _ in range(2)], i % 2) for i in range(120)]
    assert mined(spark, rows, 10) == plain(rows, 10)
    assert mined(spark, [*rows, *rows[:30]], 10) == plain([*rows, *rows[:30]], 10)


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(60, 4, 5) + [(100, None, 1), (200, [0.5, None, 0.1, 0.2], 1), (300, [nan, 0.0, 0.0, 1.0], 1), (400, [inf, 0.0, 0.0, 1.0], 1), (None, [0.5] * 4, 1),
                                  (500, [0.5] * 4, None), (600, [], 1), (601, [], 1), (602, [], 2), (700, [0.5, 0.5], 1), (701, [0.5, 0.5], 1), (702, [0.5, 0.4], 2),
                                  (800, [0.0] * 4, 2), (900, [3e6, 3e6, 1.0, 2.0], 0), (901, [3e6, 3e6, 1.0, 2.0], 0), (902, [3e6, 3e6, 1.0, 1.9], 1)]
    got = mined(spark, rows, 100)
    assert got == plain(rows, 100)
    assert {600, 700, 900} <= {r[0] for r in got}
    assert mined(spark, []) == [] and mined(spark, [(100, None, 1)]) == [] and mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []


def test_query_reads_changed_labels(spark, sf):
    given = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    given = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in given]
    df = H.op11_hard_negatives(spark, sf)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in df.collect()) == plain(given)
