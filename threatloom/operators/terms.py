"""Terms per document: frequencies, coverage, TF-IDF."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lookup


def document_frequency(docs: DataFrame, *, by: tuple = ()) -> DataFrame:
    """term, df (per group if ``by`` is given). Terms are made distinct inside the row, so a frequent term costs one
    pre-aggregated row per task."""
    return docs.select(*by, F.explode(F.array_distinct("terms")).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("df"))


def coverage(docs: DataFrame, vocabulary: DataFrame, key: str, few: bool = False) -> DataFrame:
    """Share of a document's terms that the vocabulary knows; 0 when it has no terms.

    A stop word may make up a large part of all terms, so occurrences are first
    counted per document and term, then joined on a salted key. A vocabulary of
    few terms, as that of a model, is broadcast instead, and no term is moved.
    """
    if few:
        known = F.broadcast(vocabulary.selectExpr("term AS _known"))
        terms = docs.select(key, F.explode_outer("terms").alias("term")).join(known, F.col("term") == F.col("_known"), "left")
        return terms.groupBy(key).agg(F.count("term").alias("n"), F.count("_known").alias("hit")).selectExpr(
            key, "IF(n > 0, round(hit / n, 6), 0.0D) AS coverage")
    counts = docs.select(key, F.explode_outer("terms").alias("term")).groupBy(key, "term").agg(F.count("term").alias("n"))
    joined = lookup(counts, vocabulary.selectExpr("term AS _known"), "term", "_known", [key, "term"])
    return joined.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.expr("IF(_known IS NOT NULL, n, 0)")).alias("hit")).selectExpr(
        key, "IF(n > 0, round(hit / n, 6), 0.0D) AS coverage")


def counted(terms: str) -> str:
    """array<struct<term, tf>> of an array of terms, by run lengths of the sorted array; stays inside the row."""
    s = f"array_sort({terms})"
    starts = "filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i] <> s[i - 1])"
    body = (f"transform(array(struct(s AS s, IF(size(s) > 0, {starts}, CAST(array() AS array<int>)) AS p)), "
            "r -> transform(r.p, (b, k) -> struct(r.s[b] AS term, coalesce(try_element_at(r.p, k + 2), size(r.s)) - b AS tf)))[0]")
    return f"transform(array({s}), s -> {body})[0]"


def tfidf(docs: DataFrame, key: str, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None,
          sublinear: bool = False, by: str | None = None) -> DataFrame:
    """Rows (by, key, term, df, w): tf * (ln((1+n)/(1+df)) + 1), scaled to unit length per document.

    ``docs`` carries ``terms`` array<string>. ``by`` fits every group on its own.
    """
    group = [by] if by else []
    counts = docs.selectExpr(*group, key, f"inline({counted('terms')})")
    vocabulary = counts.groupBy(*group, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    sizes = docs.groupBy(*group).agg(F.count("*").alias("n_docs"))
    vocabulary = vocabulary.join(sizes, group) if group else vocabulary.withColumn("n_docs", sizes.select("n_docs").scalar())
    vocabulary = vocabulary.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))
    if max_features:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_features)
    known = vocabulary.selectExpr(*[f"{g} AS _{g}" for g in group], "term AS _term", "df", "ln((1 + n_docs) / (1 + df)) + 1 AS idf")
    if group:
        counts = counts.withColumn("_k", F.struct(by, "term"))
        known = known.withColumn("_vk", F.struct(F.col(f"_{by}").alias(by), F.col("_term").alias("term")))
        joined = lookup(counts, known, "_k", "_vk", [key, "term"], salts=4).drop("_k", "_vk", f"_{by}")
    else:
        joined = lookup(counts, known, "term", "_term", [key, "term"], salts=4)
    tf = "(1 + ln(tf))" if sublinear else "tf"
    raw = joined.where("df IS NOT NULL").selectExpr(*group, key, "term", "df", f"{tf} * idf AS w")
    return raw


def unit_vectors(raw: DataFrame, key: str, *by: str) -> DataFrame:
    """One row per document: v array<struct<df, term, w>> of unit length, rarest terms first.

    A document's array has one entry for each of its distinct terms.
    """
    rows = raw.groupBy(*by, key).agg(F.expr("collect_list(struct(df, term, w))").alias("v"), F.sum(F.expr("w * w")).alias("ss"))
    return rows.selectExpr(*by, key, "array_sort(transform(v, x -> struct(x.df AS df, x.term AS term, x.w / sqrt(ss) AS w))) AS v")
