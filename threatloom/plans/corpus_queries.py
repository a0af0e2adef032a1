"""Corpus preparation over the derived messages."""

from pyspark.sql import functions as F

from .. import dimensions as D
from .. import fixtures as fx
from ..functions import text as X
from ..operators import corpus, near_duplicates
from ..operators.components import components
from ..operators.joins import membership
from ..oracle.cte import one_of, s, with_
from ..sources.shared import checkpointed, shared_dir, table_once
from .message_queries import NORMAL_SQL, alpha
from .registry import query

# ------------------------------------------------------------------ SQL side
BASE = with_("messages") + f""",
norm AS (SELECT msg_id AS doc, label, {NORMAL_SQL} AS text FROM messages),
toks AS (SELECT doc, {alpha('text')} AS t FROM norm),
gates AS (SELECT n.doc, n.label, n.text, CASE WHEN length(text) < 40 THEN 'empty' WHEN NOT (len(t) >= 8 AND
    len(list_filter(t, lambda x: {one_of('x', D.STOPWORDS)})) / greatest(len(t), 1) >= 0.12) THEN 'non_english' END AS drop_reason FROM norm n JOIN toks USING (doc)),
hashed AS (SELECT doc, label, text, sha256(text) AS hash FROM gates WHERE drop_reason IS NULL),
firsts AS (SELECT hash, min(doc) AS doc, min_by(label, doc) AS label, min_by(text, doc) AS text, count(*) AS n,
    count(*) FILTER (WHERE label = l0) - 1 AS duplicates, count(*) FILTER (WHERE label <> l0) AS label_conflicts
  FROM (SELECT *, first_value(label) OVER (PARTITION BY hash ORDER BY doc) AS l0 FROM hashed) GROUP BY hash)"""
GRAMS = BASE + """,
words AS (SELECT doc, label, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM firsts),
grams AS (SELECT doc, label, substring(p, i, 5) AS g FROM (SELECT doc, label, ' '||w||' ' AS p,
    unnest(range(1, greatest(length(w) + 2 - 4, 1) + 1)) AS i FROM words)),
tf AS (SELECT doc, label, g, count(*) AS tf FROM grams GROUP BY ALL),
df AS (SELECT label, g, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2),
nd AS (SELECT label, count(*) AS n FROM firsts GROUP BY label),
w0 AS (SELECT tf.doc, tf.label, tf.g, df.df, tf.tf * (ln((1 + n) / (1 + df.df)) + 1) AS w FROM tf JOIN df USING (label, g) JOIN nd USING (label)),
w AS (SELECT doc, label, g, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w0)"""
GROUPS = GRAMS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
pairs AS (SELECT x.doc AS a, y.doc AS b FROM w x JOIN w y ON x.label = y.label AND x.g = y.g AND x.doc < y.doc GROUP BY ALL
  HAVING sum(x.w * y.w) >= {D.NEAR_DUPLICATE_SIMILARITY} - 1e-9),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc, r) AS (SELECT doc, doc FROM firsts UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc),
groups AS (SELECT f.doc, f.label, min(r) AS grp FROM firsts f JOIN reach USING (doc) GROUP BY f.doc, f.label)"""
SPLITS = GROUPS + f""",
sizes AS (SELECT grp, min_by(label, doc) AS label, count(*) AS size FROM groups GROUP BY grp),
ran AS (SELECT *, sum(size) OVER (PARTITION BY label ORDER BY md5('{D.SPLIT_SEED}-'||grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    sum(size) OVER (PARTITION BY label) AS total FROM sizes),
splits AS (SELECT label, grp, size, CASE WHEN coalesce(before, 0) < 0.7 * total THEN 'train' WHEN coalesce(before, 0) < 0.85 * total THEN 'validation'
    ELSE 'test' END AS split FROM ran)"""


# ------------------------------------------------------------------ Spark side
def normal(spark, d):
    return fx.messages(spark, d).selectExpr("msg_id AS doc", "label", f"{X.normalise('subject', 'text')} AS text")


def gates(spark, d):
    return corpus.gated(normal(spark, d))


def firsts(spark, d):
    return corpus.exact_groups(gates(spark, d).where("drop_reason IS NULL"))


def first_texts(spark, d):
    """First copy of every accepted text; texts stay where they are read while their ids are few."""
    return membership(normal(spark, d), checkpointed(firsts(spark, d).select("doc")), "left_semi")


def kept_texts(spark, d):
    """First copy of every accepted text, stored."""
    return table_once(spark, f"kept_{d}", lambda: first_texts(spark, d))


def groups(spark, d):
    return table_once(spark, f"groups_{d}", lambda: near_duplicates.groups(kept_texts(spark, d)))


def splits(spark, d):
    return corpus.split_groups(groups(spark, d))


@query("cor1_quality_gates", BASE + "SELECT coalesce(drop_reason, 'kept') AS reason, label, count(*)::BIGINT AS n FROM gates GROUP BY ALL")
def cor1(spark, d):
    return gates(spark, d).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason"), "label").agg(F.count("*").alias("n"))


@query("cor2_exact_dedup", BASE + """
SELECT doc, label, hash, n::BIGINT AS n, duplicates::BIGINT AS duplicates, label_conflicts::BIGINT AS label_conflicts FROM firsts""")
def cor2(spark, d):
    return firsts(spark, d)


@query("cor2_documents_dedup", """
SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*)::BIGINT AS copies FROM documents GROUP BY sha256(text)""")
def cor2d(spark, d):
    return fx.table(spark, d, "documents").selectExpr("doc_id", "sha2(text, 256) AS hash").groupBy("hash").agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("cor3_shingles", GRAMS + "SELECT doc, count(*)::BIGINT AS distinct_grams, sum(tf)::BIGINT AS grams FROM tf GROUP BY doc")
def cor3(spark, d):
    from ..operators.terms import counted
    g = kept_texts(spark, d).selectExpr("doc", f"{X.char_wb_grams('text', [5])} AS terms").selectExpr("doc", f"{counted('terms')} AS c")
    return g.selectExpr("doc", "size(c) AS distinct_grams", "aggregate(c, 0L, (a, x) -> a + x.tf) AS grams")


@query("cor4_tfidf_l2", GRAMS + "SELECT doc, count(*)::BIGINT AS terms, round(sum(w), 4)::DOUBLE AS mass, round(max(w), 5)::DOUBLE AS top FROM w GROUP BY doc")
def cor4(spark, d):
    v = near_duplicates.gram_vectors(kept_texts(spark, d))
    return v.selectExpr("doc", "size(v) AS terms", "round(aggregate(v, 0.0D, (a, x) -> a + x.w), 4) AS mass",
                        "round(array_max(transform(v, x -> x.w)), 5) AS top")


@query("cor5_near_dup_pairs")
def cor5(spark, d):
    """Verified edges that connect the near-duplicate groups; never all pairs of a group."""
    return near_duplicates.edges(kept_texts(spark, d)).selectExpr("label", "a", "b", "round(cosine, 6) AS cosine")


@query("cor5_edge_check", GROUPS + """
SELECT label, count(*)::BIGINT AS linked, count(DISTINCT grp)::BIGINT AS joined, 0::BIGINT AS below FROM (
  SELECT label, grp, count(*) OVER (PARTITION BY label, grp) AS n FROM groups) WHERE n > 1 GROUP BY label""")
def cor5_check(spark, d):
    """What the edges must hold: ends and components of each label as in the groups, and no cosine below the threshold."""
    e = near_duplicates.edges(kept_texts(spark, d))
    e = e.select("label", "a", "b", "cosine")
    ends = e.selectExpr("label", "explode(array(a, b)) AS node").distinct().join(components(e.select("a", "b")), "node").groupBy("label").agg(
        F.count("*").alias("linked"), F.countDistinct("root").alias("joined"))
    low = e.groupBy("label").agg(F.count_if(F.col("cosine") < D.NEAR_DUPLICATE_SIMILARITY - 1e-6).alias("below"))
    return ends.join(low, "label")


@query("cor6_components", GROUPS + "SELECT doc, label, grp AS \"group\" FROM groups")
def cor6(spark, d):
    return groups(spark, d).select("doc", "label", "group")


@query("cor6_customer_components", """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, -(o_orderkey % 997) - 1 AS b FROM orders),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(n, m) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.n)
SELECT n AS node, min(m) AS root FROM r GROUP BY n""")
def cor6c(spark, d):
    """Components of a denser graph: customers linked through order key classes."""
    e = fx.table(spark, d, "orders").selectExpr("o_custkey AS a", "-(o_orderkey % 997) - 1 AS b")
    return components(e)


@query("cor7_group_stats", GROUPS + """
SELECT label, count(*)::BIGINT AS groups, count(*) FILTER (WHERE n > 1)::BIGINT AS multi, max(n)::BIGINT AS largest FROM (
  SELECT label, grp, count(*) AS n FROM groups GROUP BY label, grp) GROUP BY label""")
def cor7(spark, d):
    per = groups(spark, d).groupBy("label", "group").agg(F.count("*").alias("n"))
    return per.groupBy("label").agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("largest"))


@query("cor8_group_split", SPLITS + "SELECT label, grp AS \"group\", size::BIGINT AS size, split FROM splits")
def cor8(spark, d):
    return splits(spark, d)


@query("cor8_document_split", f"""
WITH g AS (SELECT label_key AS label, doc_id AS grp, 1 AS size FROM (SELECT doc_id, quality::VARCHAR AS label_key FROM labels)),
ran AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY label ORDER BY md5('{D.SPLIT_SEED}-'||grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) OVER (PARTITION BY label) AS total FROM g)
SELECT label, CASE WHEN before < 0.7 * total THEN 'train' WHEN before < 0.85 * total THEN 'validation' ELSE 'test' END AS split, count(*)::BIGINT AS n
FROM ran GROUP BY ALL""")
def cor8d(spark, d):
    """Split of the labels table, every document its own group."""
    g = fx.table(spark, d, "labels").selectExpr("doc_id AS doc", "string(quality) AS label", "doc_id AS `group`")
    return corpus.split_groups(g).groupBy("label", "split").agg(F.count("*").alias("n"))


@query("cor9_label_of_group", GROUPS + "SELECT grp AS \"group\", min_by(label, doc) AS label FROM groups GROUP BY grp")
def cor9(spark, d):
    return groups(spark, d).groupBy("group").agg(F.min_by("label", "doc").alias("label"))


@query("cor10_reviewed_feedback_source", with_("messages", "feedback") + """
SELECT m.msg_id, 'feedback' AS source, CASE WHEN f.verdict IN ('confirmed_phishing', 'false_negative') THEN 'phishing' ELSE 'legitimate' END AS label
FROM messages m JOIN (SELECT msg_id, max_by(verdict, id) AS verdict FROM feedback WHERE reviewed = 1 GROUP BY msg_id) f USING (msg_id)
WHERE f.verdict <> 'uncertain'""")
def cor10(spark, d):
    """Reviewed feedback as extra training rows: the latest reviewed verdict decides the label."""
    latest = fx.message_feedback(spark, d).where("reviewed = 1").groupBy("msg_id").agg(F.max_by("verdict", "id").alias("verdict"))
    return fx.messages(spark, d).select("msg_id").join(latest.where("verdict <> 'uncertain'"), "msg_id").selectExpr(
        "msg_id", "'feedback' AS source", "IF(verdict IN ('confirmed_phishing', 'false_negative'), 'phishing', 'legitimate') AS label")


def prepared(spark, d):
    """Split records: doc, id, source, label, text, group, split."""
    g = groups(spark, d).join(splits(spark, d).select("group", "split"), "group")
    return kept_texts(spark, d).join(g.select("doc", "group", "split"), "doc").selectExpr(
        "doc", "substring(sha2(text, 256), 1, 16) AS id", "IF(label = 'phishing', 'phishing_pot', 'spamassassin_ham') AS source", "label",
        "text", "concat('g', `group`) AS `group`", "split")


def split_path(spark, d):
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/jsonl_{d.strip('/').replace('/', '_')}"


@query("snk2_split_write", SPLITS + """
SELECT s.split, f.label, count(*)::BIGINT AS n, sum(length(f.text))::BIGINT AS chars FROM groups g JOIN firsts f USING (doc) JOIN splits s ON s.grp = g.grp GROUP BY ALL""")
def snk2(spark, d):
    """Records written as JSON lines per split, counted from what was written."""
    prepared(spark, d).drop("doc").write.mode("overwrite").partitionBy("split").json(split_path(spark, d) + "_w")
    back = spark.read.schema("label string, text string, split string").json(split_path(spark, d) + "_w")
    return back.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src2_split_read", SPLITS + """
SELECT sha256(f.text)[1:16] AS id, CASE WHEN f.label = 'phishing' THEN 1 ELSE 0 END::BIGINT AS y, length(f.text)::BIGINT AS chars, 'g'||g.grp AS "group", s.split
FROM groups g JOIN firsts f USING (doc) JOIN splits s ON s.grp = g.grp""")
def src2(spark, d):
    from ..sources.mail import split_jsonl
    prepared(spark, d).drop("doc").write.mode("overwrite").partitionBy("split").json(split_path(spark, d))
    return split_jsonl(spark, split_path(spark, d)).selectExpr("id", "y", "length(text) AS chars", "`group`", "split")


@query("src3_challenge_read", """
SELECT item_id::VARCHAR AS id, 'legitimate' AS label, md5('From: sender@example.com'||chr(10)||'To: analyst@example.org'||chr(10)||'Subject: item '||item_id||chr(10)||
  'MIME-Version: 1.0'||chr(10)||'Content-Type: text/plain; charset=utf-8'||chr(10)||chr(10)||text||chr(10)) AS raw_md5 FROM benchmark""")
def src3(spark, d):
    from ..sources.mail import challenge_jsonl
    path = split_path(spark, d) + "_challenge"
    fx.table(spark, d, "benchmark").selectExpr("string(item_id) AS id", "'legitimate' AS label", "concat('item ', item_id) AS subject",
                                               "text AS body").write.mode("overwrite").json(path)
    return challenge_jsonl(spark, path).selectExpr("id", "label", "md5(raw) AS raw_md5")


@query("snk3_corpus_manifest", SPLITS + """
SELECT stat, label, sum(n)::BIGINT AS n FROM (
  SELECT 'loaded' AS stat, label, count(*) AS n FROM gates GROUP BY ALL
  UNION ALL SELECT 'dropped_'||drop_reason, label, count(*) FROM gates WHERE drop_reason IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'dropped_exact_duplicate', label, sum(duplicates) FROM firsts GROUP BY label
  UNION ALL SELECT 'label_conflict', label, sum(label_conflicts) FROM firsts GROUP BY label
  UNION ALL SELECT 'kept', label, count(*) FROM firsts GROUP BY label
  UNION ALL SELECT 'split_'||split, label, sum(size) FROM splits GROUP BY ALL
  UNION ALL SELECT 'groups', label, count(*) FROM splits GROUP BY label
  UNION ALL SELECT 'multi_message_groups', label, count(*) FILTER (WHERE size > 1) FROM splits GROUP BY label) GROUP BY ALL""")
def snk3(spark, d):
    return corpus.manifest(gates(spark, d), firsts(spark, d), splits(spark, d))
