"""Groups, splits, windows, metrics, models and streams against brute force."""

import importlib
import math
import random

import pytest
from pyspark.sql import functions as F

from threatloom.functions.text import blank_words, char_wb_grams
from threatloom.learning import candidates as C
from threatloom.operators import corpus, metrics, near_duplicates
from threatloom.operators.components import components
from threatloom.operators.joins import lookup
from threatloom.operators.windows import bucketed_lag, running_total


def smallest(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, n) for n in range(101, 400)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == smallest(nodes, [e for e in edges if e[0] != e[1]])


def test_components_broadcast_no_large_hooks(spark, monkeypatch):
    module = importlib.import_module("threatloom.operators.components")
    plans = []

    def seen(*args, **options):
        df = lookup(*args, **options)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df
    monkeypatch.setattr(module, "lookup", seen)
    n = 2 * module.BROADCAST_HOOKS
    got = module.components(spark.range(1, n).selectExpr("id AS a", "-id % 7 AS b"))
    assert {r["root"] for r in got.select("root").distinct().collect()} == {-6, -5, -4, -3, -2, -1, 0}
    assert not any("BroadcastHashJoin" in p for p in plans[:2])


def brute_groups(texts, threshold):
    """Connected groups over all pairs, per label, by the textbook formula."""
    from collections import Counter, defaultdict

    def grams(t):
        out = Counter()
        for w in t.lower().split():
            p = f" {w} "
            for i in range(max(1, len(p) - 4)):
                out[p[i:i + 5]] += 1
        return out
    result = {}
    by = defaultdict(list)
    for doc, label, text in texts:
        by[label].append((doc, grams(text)))
    for rows in by.values():
        n, df = len(rows), Counter(g for _, c in rows for g in c)
        vec = {}
        for doc, c in rows:
            v = {g: k * (math.log((1 + n) / (1 + df[g])) + 1) for g, k in c.items() if df[g] >= 2}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1
            vec[doc] = {g: x / norm for g, x in v.items()}
        docs = sorted(vec)
        edges = [(a, b) for i, a in enumerate(docs) for b in docs[i + 1:]
                 if sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) >= threshold - 1e-9]
        result.update(smallest(docs, edges))
    return result


def test_near_duplicate_groups_match_brute_force(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    rows, doc = [], 0
    for family in range(8):
        base = [rng.choice(words) for _ in range(40)]
        for _ in range(rng.choice([1, 2, 5, 40])):  # one family may hold a large share of all rows
            copy = [rng.choice(words) if rng.random() < 0.06 else w for w in base]
            rows.append((doc, "phishing" if family % 2 else "legitimate", " ".join(copy)))
            doc += 1
    rows += [(doc + i, "phishing", " ".join(rng.choice(words) for _ in range(40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc long, label string, text string")
    got = {r["doc"]: r["group"] for r in near_duplicates.groups(df).collect()}
    assert got == brute_groups(rows, 0.8)
    n_edges = near_duplicates.edges(df).count()
    assert n_edges < 4 * len(rows)  # a family costs its size, not its square


def test_exact_groups_and_conflicts(spark):
    rows = [(1, "phishing", "x"), (2, "phishing", "x"), (3, "legitimate", "x"), (4, "legitimate", "y")]
    got = {r["doc"]: (r["duplicates"], r["label_conflicts"]) for r in corpus.exact_groups(spark.createDataFrame(rows, "doc long, label string, text string")).collect()}
    assert got == {1: (1, 1), 4: (0, 0)}


def test_gates(spark):
    long_en = "please verify that you have the account and the password for this now today and tomorrow"
    rows = [(1, "phishing", "short", None), (2, "phishing", "bitte konto " * 10, None), (3, "phishing", long_en, None), (4, "phishing", long_en, "ValueError")]
    got = {r["doc"]: r["drop_reason"] for r in corpus.gated(spark.createDataFrame(rows, "doc long, label string, text string, parse_error string")).collect()}
    assert got == {1: "empty", 2: "non_english", 3: None, 4: "unparseable"}


def test_split_keeps_groups_whole(spark):
    rows = [(i, "phishing" if i < 60 else "legitimate", 0 if i < 4 else i) for i in range(100)]
    g = spark.createDataFrame(rows, "doc long, label string, group long")
    s = corpus.split_groups(g)
    assert s.groupBy("group").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    n = {r["split"]: r["n"] for r in s.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert sum(n.values()) == 100 and 64 <= n["train"] <= 76 and n["validation"] > 0 and n["test"] > 0
    assert corpus.split_groups(g).orderBy("group").collect() == s.orderBy("group").collect()


def test_windows_over_hot_keys(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 0, id % 7) AS k", "(id * 7919) % 5000 AS t", "id % 11 AS v").withColumn("b", F.expr("t DIV 250"))
    got = bucketed_lag(rows, ["k"], "b", ["t", "id"], "t", "prev")
    want = rows.selectExpr("id", "lag(t) OVER (PARTITION BY k ORDER BY t, id) AS want")
    assert got.join(want, "id").where("NOT prev <=> want").count() == 0
    ran = running_total(rows, ["k"], "b", ["t", "id"], {"before": "v"})
    want = rows.selectExpr("id", "coalesce(sum(v) OVER (PARTITION BY k ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS want")
    assert ran.count() == 5000 and ran.join(want, "id").where("before <> want").count() == 0


def test_threshold_respects_budget(spark):
    rng = random.Random(3)
    rows = [(1, rng.betavariate(5, 2)) for _ in range(400)] + [(0, rng.betavariate(2, 5)) for _ in range(600)]
    scored = spark.createDataFrame(rows, "y int, score double")
    points = metrics.roc_points(scored)
    t = metrics.threshold_for_fpr(points, 0.01).first()[0]
    fp = sum(1 for y, s in rows if y == 0 and s >= t)
    assert fp / 600 <= 0.01
    lower = max((s for y, s in rows if s < t - 1e-6 and y == 0), default=0)
    assert sum(1 for y, s in rows if y == 0 and s >= lower) / 600 <= 0.012
    auc = metrics.curve_areas(points).first()["roc_auc"]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(want, abs=1e-4)


def test_metrics_edge_cases(spark):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.3), (0, 0.1)], "y int, score double")
    r = metrics.class_metrics(scored, 0.5).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["precision"], r["f1"]) == (1, 1, 1, 1, 0.5, 0.5)
    one = spark.createDataFrame([(1, 0.9), (1, 0.4)], "y int, score double")
    assert metrics.curve_areas(metrics.roc_points(one)).first()["roc_auc"] is None
    assert metrics.class_metrics(one, 0.5).first()["false_positive_rate"] is None
    worst = spark.createDataFrame([(0, 0.9), (1, 0.4)], "y int, score double")
    assert metrics.threshold_for_fpr(metrics.roc_points(worst), 0.01).first()[0] == 1.0


def test_select_only_eligible(spark):
    rows = [("svm_hybrid", False, 0, 0.99, 0.9, 0.9, 0.5), ("lr_words", True, 0, 0.9, 0.9, 0.95, 0.5), ("lr_text", True, 0, 0.9, 0.9, 0.97, 0.5)]
    assert C.select_best(spark.createDataFrame(rows, C.RESULT)).first()["candidate"] == "lr_text"
    weights = spark.createDataFrame([("structural", "ip_url", -0.5), ("structural", "body_length_log", -2.0), ("structural", "at_symbol_url", -0.1)],
                                    "kind string, name string, weight double")
    assert [r["feature"] for r in C.prior_violations(weights).collect()] == ["ip_url"]


def test_boosted_trees_train(spark):
    from pyspark.ml.linalg import Vectors
    rng = random.Random(1)
    rows = [(i, i % 2, Vectors.dense([rng.random() + i % 2, rng.random()])) for i in range(80)]
    train = spark.createDataFrame(rows, ["doc", "y", "features"])
    fitted = C.fit("gbm_structural", None, train, gbm_rounds=3)
    points = metrics.roc_points(fitted.score(train).select("y", "score"))
    assert metrics.curve_areas(points).first()["roc_auc"] > 0.9


def test_char_grams_unbounded_text(spark):
    text = "word " * 5000
    n = spark.createDataFrame([(text,)], "x string").selectExpr(f"size({char_wb_grams('x', [5])}) AS n").first()["n"]
    assert n == 10000


def test_catalogue_is_consistent(spark, sf):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 180
    assert {r["risk_level"] for r in e.entry(spark).collect()} == {"critical", "high", "medium", "low", "safe"}


def test_near_duplicates_over_several_tiles(spark, monkeypatch):
    """Few words make long lists of every gram; one tile gives a forest of edges, and several tiles give the same groups."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    bases = [[rng.choice(words) for _ in range(30)] for _ in range(20)]
    rows = [(i, "phishing", " ".join(rng.choice(words) if rng.random() < 0.1 else w for w in rng.choice(bases))) for i in range(200)] + [(900, "phishing", None)]
    df = spark.createDataFrame(rows, "doc long, label string, text string").cache()
    want = brute_groups([r[:2] + (r[2] or "",) for r in rows], 0.8)
    linked = [d for d, g in want.items() if d != g]
    one = near_duplicates.edges(df).collect()
    assert len(one) == len(linked) and all(r["a"] < r["b"] and r["cosine"] >= 0.8 - 1e-9 for r in one)
    assert {r["doc"]: r["group"] for r in near_duplicates.groups(df).collect()} == want
    monkeypatch.setattr(near_duplicates, "SMALL_CHARS", 8000)
    assert near_duplicates.tiles(df, 0.8).count() > 3
    assert {r["doc"]: r["group"] for r in near_duplicates.groups(df).collect()} == want


def test_tiles_are_sent_once_a_shelf(spark, monkeypatch):
    """More tiles than shelves: every pair of tiles meets once, no tile is sent to every other one, and groups stay right."""
    for shelves in (2, 3, 4, 7):
        pairs = [(p, q) for q in range(shelves) for p in range(q)]
        assert all(sum(near_duplicates.met_here(a, b, shelves, p, q) for p, q in pairs) == (a < b) for a in range(12) for b in range(12))
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    bases = [[rng.choice(words) for _ in range(30)] for _ in range(20)]
    rows = [(i, rng.choice(["phishing", "legitimate"]) if i < 300 else "one tile", " ".join(rng.choice(words) if rng.random() < 0.1 else w for w in rng.choice(bases)))
            for i in range(305)]
    df = spark.createDataFrame(rows, "doc long, label string, text string").cache()
    monkeypatch.setattr(near_duplicates, "SMALL_CHARS", 3000)
    made = near_duplicates.tiles(df, 0.8)
    n = {r["label"]: r["n"] for r in made.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert n["phishing"] > 5 and n["legitimate"] > 5 and n["one tile"] == 1
    times = near_duplicates.meetings(made).groupBy("label", "tile").count().collect()
    assert len(times) == n["phishing"] + n["legitimate"] and {r["count"] for r in times} == {near_duplicates.SHELVES - 1}
    got = {r["doc"]: r["group"] for r in near_duplicates.groups(df).collect()}
    assert got == {d: g for label in n for d, g in brute_groups([r for r in rows if r[1] == label], 0.8).items()}


def test_gates_make_an_expression_of_a_text_once(spark):
    rows = spark.createDataFrame([(1, "a", "please verify that you have the account and the password for this now"), (2, "a", None)], "doc long, label string, text string")
    kept = corpus.gated(rows.selectExpr("doc", "label", "regexp_replace(text, 'now', '') AS text")).where("drop_reason IS NULL").selectExpr("doc", "sha2(text, 256) AS hash")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r["doc"] for r in kept.where("hash IS NOT NULL").collect()] == [1]


def test_word_grams_are_those_of_the_expression(spark):
    text = " Ab  abcde\tÀÉîœ x abcdefgh\n\x0b12 a"
    got = spark.createDataFrame([(text,)], "t string").selectExpr(f"{char_wb_grams('t', [5])} AS g", f"{blank_words('t')} AS w").first()
    assert got["g"] == [g for w in got["w"] for g in near_duplicates.word_grams(w)]


def test_kept_texts_are_not_shuffled_to_their_ids(spark, tmp_path, monkeypatch):
    """Few ids go to the texts, whatever Spark's own limit for broadcasts; many are joined by shuffle, with the same rows."""
    from threatloom.operators import joins
    from threatloom.plans import corpus_queries as Q
    words = "please verify that you have the account and the password for this"
    spark.sql(f"SELECT id AS doc_id, concat('{words} ', repeat(chr(97 + CAST(id % 7 AS INT)), 12)) AS text FROM range(40) UNION ALL SELECT 3, '{words} again' "
              "UNION ALL SELECT NULL, 'x' UNION ALL SELECT 99, NULL").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = Q.first_texts(spark, str(tmp_path))
        assert "LeftSemi, BuildRight" in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(joins, "BROADCAST_IDS", 0)
        many = Q.first_texts(spark, str(tmp_path))
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert few.count() > 10 and sorted(few.collect()) == sorted(many.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_tile_and_pair_of_shelves_is_a_partition(spark, monkeypatch):
    """Hashed to partitions, some held several tiles or pairs of shelves, which one task then took one after the other."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    rows = [(i, ("a", "b", "c", None)[min(i % 5, 3)], " ".join(rng.choice(words) for _ in range(30))) for i in range(300)]
    monkeypatch.setattr(near_duplicates, "SMALL_CHARS", 3000)
    made = near_duplicates.tiles(spark.createDataFrame(rows, "doc long, label string, text string"), 0.8)
    sent = near_duplicates.meetings(made).withColumn("at", F.spark_partition_id())
    per = [{(r["label"], r["p"], r["q"]) for r in part} for part in sent.select("label", "p", "q").rdd.glom().collect()]
    assert [len(x) for x in per] == [1] * len(per) and len(set().union(*per)) == len(per) == 3 * near_duplicates.SHELVES * (near_duplicates.SHELVES - 1) // 2
    assert sent.select("at").distinct().count() == len(per)
    files = {r["f"]: r["n"] for r in made.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    assert sum(files.values()) == made.count() == made.select("label", "tile").distinct().count()


def test_labels_of_one_tile_have_no_meetings(spark):
    df = spark.createDataFrame([(1, "a", "one two three four"), (2, "a", "one two three four"), (3, "b", "five six"), (4, None, "seven")],
                               "doc long, label string, text string")
    assert near_duplicates.meetings(near_duplicates.tiles(df, 0.8)).count() == 0
    assert [(r["a"], r["b"]) for r in near_duplicates.edges(df).collect()] == [(1, 2)]
    assert near_duplicates.edges(df.limit(0)).count() == 0


def test_gram_vectors_match_brute_force(spark, monkeypatch):
    """No gram of a text is a row of its own on its way to the vector; the plan had each as a row."""
    from collections import Counter
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 8))) for _ in range(40)]
    rows = [(i, "ab"[i % 2], " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(80)] + [(90, "a", "zzzzzzzz"), (91, "a", None), (92, None, "abc abc")]
    monkeypatch.setattr(near_duplicates, "SMALL_CHARS", 1500)
    monkeypatch.setattr(near_duplicates, "VECTORS", 7)
    made = near_duplicates.gram_vectors(spark.createDataFrame(rows, "doc long, label string, text string"))
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0] and near_duplicates.VECTORS == 7
    got = {(r["label"], r["doc"]): [(x["df"], x["term"], x["w"]) for x in r["v"]] for r in made.collect()}
    want = {}
    for label in "ab":
        tf = {d: Counter(g for w in (t or "").split() for g in near_duplicates.word_grams(w)) for d, x, t in rows if x == label}
        df = Counter(g for c in tf.values() for g in c)
        for d, c in tf.items():
            w = {g: n * (math.log((1 + len(tf)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] >= 2}
            norm = math.sqrt(sum(x * x for x in w.values()))
            if w:
                want[label, d] = sorted((df[g], g, x / norm) for g, x in w.items())
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [x[:2] for x in got[k]] == [x[:2] for x in v] and [x[2] for x in got[k]] == pytest.approx([x[2] for x in v])


def test_texts_of_one_id_share_one_vector(spark):
    rows = [(1, "a", "hello there"), (1, "a", "hello you"), (2, "a", "hello there")]
    got = {r["doc"]: r["v"] for r in near_duplicates.gram_vectors(spark.createDataFrame(rows, "doc long, label string, text string")).collect()}
    assert set(got) == {1, 2} and all(sum(x["w"] ** 2 for x in v) == pytest.approx(1) for v in got.values())
    assert [x["term"] for x in got[1]].count(" hell") == 2 and [x["term"] for x in got[2]].count(" hell") == 1
