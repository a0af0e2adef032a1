"""Candidate models, their selection and their explanation."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dimensions as D
from ..operators import metrics
from .space import FeatureSpace, ends_of, valued

# key: (description, decomposes exactly, feature kinds)
CANDIDATES = {
    "lr_words": ("word TF-IDF, logistic regression", True, ("word",)),
    "lr_text": ("word and character TF-IDF, logistic regression", True, ("word", "char")),
    "lr_hybrid": ("word and character TF-IDF and structural features, logistic regression", True, ("word", "char", "structural")),
    "svm_hybrid": ("the same, calibrated linear SVM", False, ("word", "char", "structural")),
    "nb_words": ("word TF-IDF, complement naive Bayes", False, ("word",)),
    "gbm_structural": ("structural features, boosted trees", False, ("structural",)),
}


@dataclass
class Fitted:
    key: str
    space: FeatureSpace
    model: object
    platt: object = None

    def score(self, vectors: DataFrame) -> DataFrame:
        """vectors(doc, features, ...) with the probability of phishing as ``score``."""
        if self.platt is not None:
            margins = margin_of(self.model, vectors)
            out = self.platt.transform(margins.withColumn("features", as_vector("margin")))
        else:
            out = self.model.transform(vectors)
        return out.withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def weights(self) -> DataFrame:
        """kind, name, weight of a linear model."""
        spark = self.space.columns.sparkSession
        rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(self.model.coefficients.toArray())], "idx int, weight double")
        return self.space.columns.join(F.broadcast(rows), "idx").select("kind", "name", "weight")


def as_vector(column: str):
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(F.array(F.col(column)))


def margin_of(model, vectors: DataFrame) -> DataFrame:
    return model.transform(vectors).withColumn("margin", vector_to_array("rawPrediction")[1]).drop(
        "rawPrediction", "probability", "prediction", "features")


def balanced(rows: DataFrame) -> DataFrame:
    """Add weight = n / (2 * n of the class)."""
    counts = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    return rows.withColumn("_n", counts.select("n").scalar()).withColumn("_p", counts.select("p").scalar()).selectExpr(
        "*", "_n / (2.0D * IF(y = 1, _p, _n - _p)) AS weight").drop("_n", "_p")


def fit(key: str, space: FeatureSpace, train: DataFrame, gbm_rounds: int = 300) -> Fitted:
    """Train one candidate on train(doc, y, features)."""
    train = train.withColumn("y", F.col("y").cast("double"))
    if key.startswith("lr_"):
        rows = balanced(train)
        total = rows.agg(F.sum("weight")).first()[0]
        lr = LogisticRegression(labelCol="y", weightCol="weight", regParam=1.0 / (4.0 * total), elasticNetParam=0.0,
                                standardization=False, maxIter=200, tol=1e-4)
        return Fitted(key, space, lr.fit(rows))
    if key == "svm_hybrid":
        rows = balanced(train)
        total = rows.agg(F.sum("weight")).first()[0]
        svc = LinearSVC(labelCol="y", weightCol="weight", regParam=1.0 / (0.5 * total), standardization=False, maxIter=100, tol=1e-4)
        folded = rows.withColumn("fold", F.pmod(F.xxhash64("doc"), F.lit(3)))
        margins = None
        for k in range(3):
            part = svc.fit(folded.where(F.col("fold") != k))
            one = margin_of(part, folded.where(F.col("fold") == k)).select("y", "margin")
            margins = one if margins is None else margins.unionByName(one)
        platt = LogisticRegression(labelCol="y", regParam=0.0, maxIter=100).fit(margins.withColumn("features", as_vector("margin")))
        return Fitted(key, space, svc.fit(rows), platt)
    if key == "nb_words":
        return Fitted(key, space, NaiveBayes(labelCol="y", modelType="complement", smoothing=0.3).fit(train))
    return Fitted(key, space, GBTClassifier(labelCol="y", maxIter=gbm_rounds, stepSize=0.05, maxDepth=5, seed=D.SPLIT_SEED).fit(train))


def prior_violations(weights: DataFrame) -> DataFrame:
    """Structural weights that contradict what is known about the feature."""
    return weights.where((F.col("kind") == "structural") & F.col("name").isin(D.NON_NEGATIVE_PRIORS)
                         & (F.col("weight") < D.PRIOR_TOLERANCE)).selectExpr("name AS feature", "round(weight, 4) AS weight")


def evaluation_row(fitted: Fitted, validation: DataFrame, budget: float = D.MAX_FPR) -> tuple:
    """(candidate, eligible, violations, recall at budget, roc_auc, pr_auc, threshold) on the validation split."""
    scored = fitted.score(validation).select("y", "score").persist()
    points = metrics.roc_points(scored).persist()
    areas = metrics.curve_areas(points).first()
    recall = metrics.recall_at_fpr(points, budget).first()[0]
    threshold = metrics.threshold_for_fpr(points, budget).first()[0]
    violations = prior_violations(fitted.weights()).count() if fitted.key.startswith("lr_") else 0
    points.unpersist()
    scored.unpersist()
    eligible = CANDIDATES[fitted.key][1] and violations == 0
    return (fitted.key, eligible, violations, round(float(recall), 4), areas[0], areas[1], float(threshold))


RESULT = ("candidate string, eligible boolean, violations int, recall_at_fpr double, roc_auc double, pr_auc double, threshold double")


def select_best(results: DataFrame) -> DataFrame:
    """Eligible candidate with the best recall in budget, then average precision."""
    return results.where("eligible").orderBy(F.desc("recall_at_fpr"), F.desc("pr_auc"), "candidate").limit(1)


def top_weights(weights: DataFrame, k: int = 25) -> DataFrame:
    """Strongest weights toward each class."""
    up = weights.orderBy(F.desc("weight"), "name").limit(k).withColumn("toward", F.lit("phishing"))
    down = weights.orderBy(F.asc("weight"), "name").limit(k).withColumn("toward", F.lit("legitimate"))
    return up.unionByName(down).selectExpr("toward", "kind", "name", "round(weight, 4) AS weight")


def assess(scored: DataFrame, threshold: float) -> DataFrame:
    """scored(doc, score, coverage, chars) -> probability, label, margin and confidence."""
    from ..operators.scoring import logit
    df = scored.selectExpr("*", f"{logit('score')} - {logit(f'{threshold}D')} AS margin")
    return df.selectExpr(
        "doc", "round(score, 4) AS probability", f"IF(score >= {threshold}D, 'phishing', 'legitimate') AS label", "round(margin, 3) AS margin",
        "round(coverage, 3) AS coverage", "CASE WHEN coverage < 0.5D OR chars < 80 THEN 'low' WHEN abs(margin) >= 3 THEN 'high' "
        "WHEN abs(margin) >= 1.2D THEN 'medium' ELSE 'low' END AS confidence")


_TERMS = pa.list_(pa.struct([("name", pa.string()), ("contribution", pa.float64())]))
CONTRIBUTIONS = "doc {}, total double, chars double, terms array<struct<name: string, contribution: double>>, structural array<struct<name: string, contribution: double>>"


def _contributed(weight: np.ndarray, positive: int, negative: int):
    def make(kinds, batch, rows, columns, tf):
        rows, columns, values = valued(kinds, rows, columns, tf, batch)
        kind, name = np.full(len(weight), "", object), np.full(len(weight), None, object)
        for k, (names, at, _) in kinds.items():
            kind[at], name[at] = k, names
        value = values * weight[columns]
        rows, columns, value = rows[value != 0], columns[value != 0], value[value != 0]
        ends, of = ends_of(rows, batch.num_rows).to_pylist(), kind[columns]
        out = []
        for a, b in zip(ends, ends[1:]):
            c, v, k = columns[a:b], value[a:b], of[a:b]
            w = np.flatnonzero(k == "word")
            w = w[np.lexsort((c[w], -v[w]))]  # columns of a kind are in the order of names
            w = np.concatenate((w[v[w] > 0][:positive], w[v[w] < 0][::-1][:negative]))
            x = np.flatnonzero(k == "structural")
            chars = v[k == "char"]
            named = [[{"name": name[c[i]], "contribution": v[i]} for i in some] for some in (w, x)]
            out.append((v.sum() if len(v) else None, chars.sum() if len(chars) else None, *named))
        cells = [pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, (pa.float64(), pa.float64(), _TERMS, _TERMS))]
        return pa.RecordBatch.from_arrays([batch.column("doc"), *cells], ["doc", "total", "chars", "terms", "structural"])
    return make


def contributions(space: FeatureSpace, texts: DataFrame, features: DataFrame | None, weights: DataFrame, positive: int = 8, negative: int = 4) -> DataFrame:
    """doc with the sum of value * weight over all its features, over characters, of its strongest words either way and of each structural feature.

    Features of a document without a text are explained too.
    """
    own = space.columns.join(weights, ["kind", "name"]).select("idx", "weight").toArrow()
    weight = np.zeros(space.size)
    weight[own.column("idx").to_numpy()] = own.column("weight").to_numpy()
    texts = texts.select("doc", "text")
    return space.mapped(texts, features, _contributed(weight, positive, negative), CONTRIBUTIONS.format(texts.schema["doc"].dataType.simpleString()), "full")[0]


def explain(contribs: DataFrame) -> DataFrame:
    """What moved each score, strongest first (place): the strongest words either way, all structural features, characters summed."""
    words = contribs.selectExpr("doc", "inline(terms)").selectExpr("doc", "'term' AS kind", "name AS feature", "round(contribution, 4) AS weight")
    chars = contribs.where("chars IS NOT NULL").selectExpr(
        "doc", "'character_patterns' AS kind", "'Character n-gram patterns' AS feature", "round(chars, 4) AS weight")
    rest = contribs.selectExpr("doc", "inline(structural)").selectExpr("doc", "'structural' AS kind", "name AS feature", "round(contribution, 4) AS weight")
    every = words.unionByName(chars).unionByName(rest)
    strongest = W.partitionBy("doc").orderBy(F.abs("weight").desc(), "kind", "feature")
    return every.withColumn("place", F.row_number().over(strongest))
