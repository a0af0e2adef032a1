"""Labelled corpus preparation: gates, exact duplicates, groups, splits, manifest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dimensions as D
from ..functions.text import is_english
from .windows import running_total


def gated(rows: DataFrame) -> DataFrame:
    """rows(doc, label, text[, parse_error]) with drop_reason: unparseable, empty, non_english, in that order, or null."""
    bad = "parse_error IS NOT NULL" if "parse_error" in rows.columns else "false"
    # A text that is an expression is made once a row, not once for every use.
    return rows.selectExpr("inline(array(struct(*)))").selectExpr("*", f"CASE WHEN {bad} THEN 'unparseable' WHEN length(text) < {D.MIN_TEXT_CHARS} THEN 'empty' "
                                f"WHEN NOT {is_english('text')} THEN 'non_english' END AS drop_reason")


def exact_groups(kept: DataFrame) -> DataFrame:
    """One row per distinct text: the first row in corpus order and how its copies were counted.

    Only hashes, ids and labels move, and copies collapse before the shuffle,
    so a text that makes up a third of the corpus costs one row per task.
    """
    hashed = kept.selectExpr("doc", "label", "sha2(text, 256) AS hash")
    per_label = hashed.groupBy("hash", "label").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    return per_label.groupBy("hash").agg(
        F.min("doc").alias("doc"), F.min_by("label", "doc").alias("label"), F.sum("n").alias("n"),
        F.collect_list(F.struct("label", "n")).alias("by_label")).selectExpr(
        "doc", "label", "hash", "n",
        "coalesce(aggregate(filter(by_label, x -> x.label = label), 0L, (a, x) -> a + x.n), 0) - 1 AS duplicates",
        "n - coalesce(aggregate(filter(by_label, x -> x.label = label), 0L, (a, x) -> a + x.n), 0) AS label_conflicts")


def split_groups(grouped: DataFrame, train: float = D.SPLIT_TRAIN, validation: float = D.SPLIT_VALIDATION,
                 seed: int = D.SPLIT_SEED) -> DataFrame:
    """grouped(doc, label, group) -> (label, group, size, split): whole groups in hashed order, by the messages before them.

    The order is a hash of seed and group; its first digits cut the order into
    even buckets, so the running count never needs all groups of a label in one task.
    """
    g = grouped.groupBy("group").agg(F.min_by("label", "doc").alias("label"), F.count("*").alias("size"))
    g = g.selectExpr("label", "`group`", "size", f"md5(concat('{seed}-', `group`)) AS k")
    g = g.selectExpr("*", "substring(k, 1, 3) AS bucket")
    ran = running_total(g, ["label"], "bucket", ["k", "group"], {"before": "size"})
    totals = g.groupBy("label").agg(F.sum("size").alias("total"))
    return ran.join(totals, "label").selectExpr(
        "label", "`group`", "size", f"CASE WHEN before < {train}D * total THEN 'train' WHEN before < {train + validation}D * total "
        "THEN 'validation' ELSE 'test' END AS split")


def manifest(gates: DataFrame, firsts: DataFrame, splits: DataFrame) -> DataFrame:
    """Counts (stat, label, n) of everything that happened to the corpus."""
    loaded = gates.groupBy("label").agg(F.count("*").alias("n")).selectExpr("'loaded' AS stat", "label", "n")
    dropped = gates.where("drop_reason IS NOT NULL").groupBy("drop_reason", "label").agg(F.count("*").alias("n")).selectExpr(
        "concat('dropped_', drop_reason) AS stat", "label", "n")
    copies = firsts.groupBy("label").agg(F.sum("duplicates").alias("d"), F.sum("label_conflicts").alias("c"), F.count("*").alias("k"))
    copies = copies.selectExpr("label", "stack(3, 'dropped_exact_duplicate', d, 'label_conflict', c, 'kept', k) AS (stat, n)").select(
        "stat", "label", "n")
    parts = splits.groupBy("split", "label").agg(F.sum("size").alias("n")).selectExpr("concat('split_', split) AS stat", "label", "n")
    grouped = splits.groupBy("label").agg(F.count("*").alias("g"), F.count_if(F.col("size") > 1).alias("m")).selectExpr(
        "label", "stack(2, 'groups', g, 'multi_message_groups', m) AS (stat, n)").select("stat", "label", "n")
    return loaded.unionByName(dropped).unionByName(copies).unionByName(parts).unionByName(grouped)
