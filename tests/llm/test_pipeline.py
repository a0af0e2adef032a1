import re
from collections import Counter

import corpus_pipeline as C


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {"documents": docs.collect()}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, sf)
        path = f"{C.shared_dir(spark)}/test-{C.uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: Counter(r["doc_id"] for r in v) for k, v in kept.items()}
    order = ["documents", "toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(set(ids[b]) <= set(ids[a]) for a, b in zip(order, order[1:]))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    same = Counter(" ".join(words(r["text"])) for r in kept["near_duplicates"])
    assert not [t for t, n in same.items() if t and n > 1]
    assert not [r for r in kept["decontamination"] for b in benchmark if b in (r["text"] or "")]
    assert max(ids["mixing"].values()) <= 2 and ids["mixing"] == ids["sharding"]
    sizes = Counter(r["shard"] for r in kept["sharding"])
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES] == order[1:]
