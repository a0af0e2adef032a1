import math
import zlib

import pytest

from threatloom.llm import toxicity as X


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return labels, X.op1_score_toxicity(spark, sf).collect()


def test_held_out_accuracy(scored):
    labels, rows = scored
    assert len(rows) == 10_000 and len({r["doc_id"] for r in rows}) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    print(sum(toxic) / len(toxic), sum(clean) / len(clean))
    # 330 toxic rows to learn from, in four languages; with more, more is found (README).
    assert sum(toxic) > 0.8 * len(toxic) and sum(clean) < 0.02 * len(clean)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", 0.5), (2, "", "a", 0.5), (None, "some words", "b", 0.5), (3, "x" * 300_000, "b", 0.5), (3, "x" * 300_000, "b", 0.5)],
                                 "doc_id int, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (5, None)], "doc_id int, toxic int")
    rows = X.score_toxicity(docs, labels).collect()
    assert len(rows) == 5 and len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    none = X.score_toxicity(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert X.score_toxicity(docs.limit(0), labels).count() == 0
    assert X.without_toxic(docs, labels.limit(0)).columns == docs.columns


def test_training_separates_invented_vocabulary():
    plain = [f"the quick fox number {i} jumps over lazy dogs and runs {i * 7} miles home".encode() for i in range(80)]
    bad = [t + b" grobnitz vorplex" for t in plain[:40]]
    model = X.train(bad, plain, 0.3)
    clean = b"over the fox and home"
    s = model.score([b"over the fox grobnitz vorplex", clean, b" ".join([clean] * 2), b" ".join([clean] * 200)])
    assert s[0] > 0.5 > s[1] and max(s[2:]) < 0.5


def test_scores_follow_compressed_lengths():
    plain = [f"the quick fox number {i} jumps over lazy dogs and runs {i * 7} miles home".encode() for i in range(80)]
    model = X.train([t + b" grobnitz vorplex" for t in plain[:40]], plain, 0.3)
    text = b"Grobnitz runs over number 5, vorplexing " + "日本語".encode() * 30
    words = X.windows(text)
    assert b"".join(words[:6]) == b"grobnitzrunsovernumber5vorplexing" and b"".join(words[6:]) == "日本語".encode() * 30
    assert all(len(w) <= X.PIECE and w.decode() for w in words)
    gains = [max(0, min(X.LEVELS[-1], sum(len(model.ordinary.compress(x)) - len(model.toxic.compress(x)) for x in (a + X.MARK + w + b for a, b in model.contexts))))
             for w in words]
    assert gains[0] >= 3 and gains[5] >= 3 and gains[1] == gains[2] == 0
    reached = [len(gains), *(sum(g >= k for g in gains) for k in X.LEVELS)]
    assert model.reached(text).tolist() == reached
    rates = [math.log((c + X.PRIOR) / (len(gains) * e + X.PRIOR)) for c, e in zip(reached[1:], model.expected)]
    at = sum((r - m) / s * w for r, m, s, w in zip(rates, model.mean, model.scale, model.weights)) + model.weights[-1]
    assert abs(model.score([text])[0] - 1 / (1 + math.exp(-at))) < 1e-9


def test_telling_words_against_plain_counts():
    bad, plain = [b"alpha grobnitz beta", b"grobnitzer gamma", b"delta grobnitzes"] * 3, [b"alpha beta gamma delta"] * 9 + [b"grob"]
    assert sorted(X.telling_words(bad, plain)) == [b"grobnitz", b"grobnitzer", b"grobnitzes"]
    assert X.telling_words(bad, [*plain, *bad]) == [] and X.telling_words([b""], plain) == []


def test_ordinary_windows_come_from_whole_texts():
    texts = [b" ".join(b"%s%dx%d" % (w, i, j) for j in range(2000)) for i in range(4) for w in (b"word",)]
    chosen = X.sampled_windows(texts, 20_000)
    assert 0 < len(X.joined(chosen)) <= 20_000 and len(set(chosen)) == len(chosen)
    at = [tuple(map(int, w[4:].split(b"x"))) for w in chosen]
    assert {i for i, _ in at} == set(range(4)) and max(j for _, j in at) > 1900


def test_passages_at_the_end_of_long_texts_are_learned(spark):
    filler = " ".join(f"plain{k % 50} field{k % 70}" for k in range(1600)) + " "
    rows = [(i, filler + ("grobnitz vorplex " * 9 if i % 2 else "meadow harvest " * 9), i % 2) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    assert len(filler) > 20_000
    scored = X.score_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in scored)
