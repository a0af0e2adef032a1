import zlib
from collections import Counter

import numpy as np

from threatloom.llm import sharding as S


def test_hypergeometric_distribution():
    rng = np.random.default_rng(1)
    draws = np.array([S.hypergeometric(rng, 40, 60, 30) for _ in range(4000)])
    want = np.random.default_rng(2).hypergeometric(40, 60, 30, 4000)
    assert abs(draws.mean() - 12) < 0.2 and abs(draws.std() - want.std()) < 0.15
    assert draws.min() >= 0 and draws.max() <= 30
    assert S.hypergeometric(rng, 5, 0, 3) == 3 and S.hypergeometric(rng, 0, 5, 3) == 0
    big = [S.hypergeometric(rng, 10**12, 3 * 10**12, 10**9) for _ in range(50)]
    assert abs(np.mean(big) / 2.5e8 - 1) < 1e-3


def test_matrix_has_exact_sums():
    counts = [0, 7, 100, 3, 55, 1]
    m = S.matrix(counts, 24, 3)
    assert m.sum(axis=1).tolist() == counts and sorted(set(m.sum(axis=0))) in ([6, 7],)


def test_query(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = S.op5_shard_documents(spark, sf).collect()
    assert len(rows) == len(texts)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]))
        assert r["law"] == "rows" and r["grown_shard"] is None
    again = S.op5_shard_documents(spark, sf).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x", "b"), (None, "x", "b"), (2, "", "c"), (3, "y" * 200_000, "d")],
                                 "doc_id long, text string, shard string")
    out = S.shard_rows(docs, shards=4)
    rows = out.collect()
    assert len(rows) == 6 and sorted(Counter(r["shard"] for r in rows).values()) == [1, 1, 2, 2]
    assert len({(r["shard"], r["slot"]) for r in rows}) == 6
    assert out.columns == ["doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert S.shard_rows(docs.limit(0)).count() == 0


def test_counts_reach_the_cluster_without_python_workers(spark, monkeypatch):
    """Workers for a list of rows stayed beside the others of the executor, whose memory they share."""
    from pyspark import SparkContext
    docs = spark.sql("SELECT id AS doc_id, concat('t', id) AS text FROM range(60)")
    calls = []
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, f=SparkContext.parallelize, **k: calls.append(a) or f(*a, **k))
    rows = S.shard_rows(docs).collect()
    assert not calls
    assert sorted(Counter(r["shard"] for r in rows).values()) == [2] * 12 + [3] * 12
    assert S.shard_rows(docs.limit(0)).collect() == []
