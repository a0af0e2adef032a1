"""Evaluation of scored rows (y 0/1, score)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import running_total

BUCKETS = 256


def roc_points(scored: DataFrame) -> DataFrame:
    """score, pos, neg, tp, fp per distinct score, highest first; tp and fp include the score itself.

    Equal scores collapse before the shuffle. The running counts use buckets
    cut at quantiles of the distinct scores, so clumped scores stay balanced.
    """
    per = scored.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(F.expr("1 - y")).alias("neg"))
    steps = ", ".join(f"{i / BUCKETS}D" for i in range(1, BUCKETS))
    cuts = per.agg(F.expr(f"percentile_approx(score, array({steps}), 4096)").alias("c")).scalar()
    per = per.withColumn("_c", cuts).selectExpr("score", "pos", "neg", "size(filter(_c, c -> c > score)) AS bucket", "-score AS down")
    ran = running_total(per, [], "bucket", ["down"], {"tp0": "pos", "fp0": "neg"})
    return ran.selectExpr("score", "pos", "neg", "tp0 + pos AS tp", "fp0 + neg AS fp")


def _totals(points: DataFrame):
    return points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))


def rates(points: DataFrame) -> DataFrame:
    t = _totals(points)
    return points.withColumn("_p", t.select("p").scalar()).withColumn("_n", t.select("n").scalar()).selectExpr(
        "score", "pos", "neg", "tp", "fp", "try_divide(tp, _p) AS tpr", "try_divide(fp, _n) AS fpr", "_p", "_n")


def threshold_for_fpr(points: DataFrame, budget: float) -> DataFrame:
    """Lowest score whose false-positive rate stays within the budget, nudged up; 1.0 when there is none."""
    return rates(points).where(F.col("fpr") <= budget).agg(F.min("score").alias("s")).selectExpr(
        "coalesce(least(s + 1e-9D, 1.0D), 1.0D) AS threshold")


def recall_at_fpr(points: DataFrame, budget: float) -> DataFrame:
    return rates(points).where(F.col("fpr") <= budget).agg(F.coalesce(F.max("tpr"), F.lit(0.0)).alias("recall"))


def curve_areas(points: DataFrame) -> DataFrame:
    """roc_auc (ties count half) and average precision; null unless both classes occur."""
    return rates(points).agg(
        F.sum(F.expr("pos * (_n - fp + neg / 2.0D)")).alias("a"), F.max("_p").alias("p"), F.max("_n").alias("n"),
        F.sum(F.expr("try_divide(pos, _p) * tp / (tp + fp)")).alias("ap")).selectExpr(
        "IF(p > 0 AND n > 0, round(a / (p * n), 4), NULL) AS roc_auc", "IF(p > 0 AND n > 0, round(ap, 4), NULL) AS pr_auc")


def class_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """Counts and rates at a threshold, four decimals, null where undefined."""
    t = f"score >= {threshold}D"
    c = scored.agg(F.count_if(F.expr(f"{t} AND y = 1")).alias("tp"), F.count_if(F.expr(f"{t} AND y = 0")).alias("fp"),
                   F.count_if(F.expr(f"NOT {t} AND y = 0")).alias("tn"), F.count_if(F.expr(f"NOT {t} AND y = 1")).alias("fn"))
    c = c.selectExpr("tp", "fp", "tn", "fn", "round(try_divide(tp, tp + fp), 4) AS precision", "round(try_divide(tp, tp + fn), 4) AS recall",
                     "round(try_divide(tp + tn, tp + fp + tn + fn), 4) AS accuracy",
                     "round(try_divide(fp, fp + tn), 4) AS false_positive_rate", "round(try_divide(fn, fn + tp), 4) AS false_negative_rate")
    return c.selectExpr("*", "IF(precision > 0 AND recall > 0, round(2 * precision * recall / (precision + recall), 4), NULL) AS f1")


def hard_errors(scored: DataFrame, threshold: float, key: str, k: int = 40) -> DataFrame:
    """Misclassified rows farthest from the threshold."""
    return scored.where(f"int(score >= {threshold}D) <> y").selectExpr(
        key, "IF(y = 1, 'phishing', 'legitimate') AS label", "round(score, 4) AS score").selectExpr(
        "*", f"abs(score - {threshold}D) AS _m").orderBy(F.desc("_m"), key).limit(k).drop("_m")
