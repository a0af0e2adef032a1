"""Vocabulary, vectors and explanations against brute force."""

import math
import re
from collections import Counter

import pytest

from threatloom import dimensions as D
from threatloom.functions.text import char_wb_grams
from threatloom.learning import candidates as C
from threatloom.learning import space as S

TEXTS = [
    (1, "please verify your account now verify your account"), (2, "your account is fine a b c please keep calm"), (3, "verify now aaaaaa aaaaaa"),
    (4, "Ünïted über words please verify account now"), (5, ""), (6, None), (7, "please please please verify your account's state now"),
    (8, "your account now and your account then, aaaaaa"), (8, "your account now and your account then, aaaaaa")]
WORD = r"(?<![^\W])([a-z][a-z0-9']+)(?![^\W])"


def words(text):
    w = re.findall(WORD, (text or "").lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def grams(text):
    out = []
    for v in re.split(r"\s+", (text or "").lower()):
        w = f" {v} "
        out += [w[i:i + 3] for i in range(len(w) - 2)] if v else []
        out += [w[i:i + n] for n in (4, 5) if v and len(w) >= n for i in range(len(w) - n + 1)]
    return out


@pytest.fixture(scope="module")
def made(spark):
    """A space of all kinds over TEXTS; document 9 has features and no text, documents 3 and 5 have no features."""
    texts = spark.createDataFrame(TEXTS, "doc long, text string").repartition(3)
    names = D.STRUCTURAL_FEATURES
    values = {d: [float((d * 7 + i) % 5) for i in range(len(names))] for d in (1, 2, 4, 6, 7, 8, 9)}
    feats = spark.createDataFrame([(d, *v) for d, v in values.items()], "doc long, " + ", ".join(f"{n} double" for n in names))
    return texts, feats, values, S.FeatureSpace.fit(texts, feats, ("word", "char", "structural"))


def fitted(cut, min_df, max_df):
    df = Counter(t for _, x in TEXTS for t in set(cut(x)))
    return {t: math.log((1 + len(TEXTS)) / (1 + n)) + 1 for t, n in df.items() if min_df <= n <= max_df * len(TEXTS)}


def expected(text, structural, columns):
    out = {}
    for kind, cut in (("word", words), ("char", grams)):
        idf = fitted(cut, *S.LIMITS[kind])
        w = {t: (1 + math.log(n)) * idf[t] for t, n in Counter(cut(text)).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {columns[kind, t]: x / norm for t, x in w.items()}
    return out | {columns["structural", n]: x for n, x in structural.items() if x}


def scaled(values):
    out = {d: {} for d in values}
    for i, n in enumerate(D.STRUCTURAL_FEATURES):
        xs = [v[i] for v in values.values()]
        mean = sum(xs) / len(xs)
        std = math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs))
        for d in values:
            out[d][n] = max(-5, min(5, (values[d][i] - mean) / std if std else values[d][i] - mean))
    return out


def test_token_grams(spark):
    tokens = ["a", "bc", "déf", "ghij", "aaaaaa", "😀x", "something,"]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").selectExpr("t", f"{char_wb_grams('t', list(S.SIZES))} AS g").collect()
    assert all(S.token_grams(r["t"]) == [*sorted(r["g"], key=len)] or Counter(S.token_grams(r["t"])) == Counter(r["g"]) for r in rows)


def test_vocabulary(made):
    _, _, _, space = made
    for kind, cut in (("word", words), ("char", grams)):
        got = {r["name"]: r["idf"] for r in space.vocab.where(f"kind = '{kind}'").collect()}
        assert got == pytest.approx(fitted(cut, *S.LIMITS[kind]))


def test_terms_are_handed_on_before_they_are_many(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(S, "HELD", 5)
    batches = [pa.RecordBatch.from_pydict({"tokens": pa.array([x, x[:1], None], pa.list_(pa.string()))}) for x in (["one", "two", "one"], ["two", "six"], [])]
    out = [b.to_pydict() for b in S._counting("char")(iter(batches))]
    assert len(out) == 2
    total, df = Counter(), Counter()
    for b in out:
        total.update(dict(zip(b["term"], b["total"])))
        df.update(dict(zip(b["term"], b["df"])))
    assert total[" two "] == 3 and df[" two "] == 3 and total[" one "] == 3 and df[" one "] == 2 and df["six"] == 1


def test_vectors_of_texts_that_come_twice_and_of_none(made):
    """Each row has its own vector; repeated ids once named each column twice, which is no vector."""
    texts, feats, values, space = made
    columns = {(r["kind"], r["name"]): r["idx"] for r in space.columns.collect()}
    rows = space.vectors(texts.withColumn("y", texts["doc"] % 2), feats).collect()
    assert sorted(r["doc"] for r in rows) == [1, 2, 3, 4, 5, 6, 7, 8, 8] and all(r["y"] == r["doc"] % 2 for r in rows)
    structural = scaled(values)
    for r in rows:
        v = r["features"]
        assert v.size == space.size == len(columns)
        assert dict(zip(v.indices.tolist(), v.values.tolist())) == pytest.approx(expected(dict(TEXTS)[r["doc"]], structural.get(r["doc"], {}), columns))


def test_contributions(spark, made):
    texts, feats, values, space = made
    columns = {(r["kind"], r["name"]): r["idx"] for r in space.columns.collect()}
    weight = {c: ((i * 37) % 11 - 5) / 7 for c, i in columns.items()}
    weights = spark.createDataFrame([(k, n, w) for (k, n), w in weight.items()], "kind string, name string, weight double")
    single = texts.where("doc < 8")
    rows = {r["doc"]: r for r in C.contributions(space, single, feats.where("doc <> 8"), weights, 3, 2).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 9]
    structural, by = scaled(values), {i: c for c, i in columns.items()}
    for doc, r in rows.items():
        want = {by[i]: x * weight[by[i]] for i, x in expected(dict(TEXTS).get(doc), structural.get(doc, {}), columns).items()}
        want = {c: x for c, x in want.items() if x}
        of = lambda kind: [(n, x) for (k, n), x in want.items() if k == kind]
        assert (r["total"] or 0) == pytest.approx(sum(want.values())) and (r["chars"] or 0) == pytest.approx(sum(x for _, x in of("char")))
        up = sorted((x for x in of("word") if x[1] > 0), key=lambda x: (-x[1], x[0]))[:3]
        down = sorted(x[1] for x in of("word") if x[1] < 0)[:2]
        assert [t["contribution"] for t in r["terms"]] == pytest.approx([x for _, x in up] + down)
        assert {t["name"]: t["contribution"] for t in r["structural"]} == pytest.approx(dict(of("structural")))
    places = [x for x in C.explain(C.contributions(space, single, feats.where("doc <> 8"), weights)).collect() if x["doc"] == 9]
    assert {x["kind"] for x in places} == {"structural"} and sorted(x["place"] for x in places) == [*range(1, len(places) + 1)]


def test_coverage_by_few_terms_moves_no_term(spark):
    from threatloom.operators.terms import coverage
    docs = spark.createDataFrame([(1, ["a", "a", "b", "x"]), (2, []), (3, None), (4, ["x", None]), (5, ["b", "b"]), (5, ["x"]), (None, ["a"])], "doc long, terms array<string>")
    vocab = spark.createDataFrame([("a",), ("b",)], "term string")
    few = coverage(docs, vocab, "doc", few=True)
    assert sorted(few.collect(), key=str) == sorted(coverage(docs, vocab, "doc").collect(), key=str) and {r["doc"]: r["coverage"] for r in few.collect()}[1] == 0.75
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()


def test_counts_are_stored_not_vectors(made, monkeypatch):
    """Stored vectors took eight times the room of their texts."""
    texts, feats, _, space = made
    stored = []
    monkeypatch.setattr(S, "BATCH", 4)
    monkeypatch.setattr(S, "checkpointed", lambda df, f=S.checkpointed: stored.append(df.schema.names) or f(df))
    assert space.vectors(texts, feats).columns == ["doc", "features"] and stored == [["doc", "structural", "steps", "tf"]]
