"""Model inputs, training, evaluation and explanation."""

from pyspark.sql import functions as F

from .. import dimensions as D
from .. import fixtures as fx
from ..functions.features import body_features, structural
from ..functions.html import concealed_texts, count_of, form_array
from ..learning import candidates as C
from ..learning import registry as R
from ..learning.space import FeatureSpace, scaled, scaling, vocabulary
from ..operators import metrics
from ..operators.joins import membership
from ..oracle.cte import IPV4, is_ip, one_of, s, with_
from ..sources.shared import shared_dir, table_once
from .corpus_queries import BASE, groups, kept_texts, splits
from .registry import query

# ------------------------------------------------------------------ structural features
HOST = "lower(split_part(regexp_replace(netloc, '^.*@', ''), ':', 1))"
LAST1, LAST2 = "string_split(host, '.')[-1]", "array_to_string(string_split(host, '.')[-2:], '.')"
BODY_SQL = f"""
  length(text) AS chars, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS upper,
  greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS words, length(text) - length(replace(text, '!', '')) AS bangs,
  len(regexp_extract_all(text, {s(D.ML_URGENCY)})) AS urgency, len(regexp_extract_all(text, {s(D.ML_CREDENTIAL)})) AS credential"""
FEA = with_("messages", "message_links", "message_files", "html_counts") + f""",
u0 AS (SELECT DISTINCT msg_id, url, regexp_extract(url, '(?i)^[a-z]+://([^/?#]*)', 1) AS netloc FROM message_links
  WHERE source IN ('anchor', 'text') AND regexp_matches(url, '(?i)^(https?://|www\\.)')),
u1 AS (SELECT *, {HOST} AS host FROM u0),
ent AS (SELECT msg_id, url, 0.0 - sum(n / t * log2(n / t)) AS entropy FROM (SELECT msg_id, url, ch, count(*) AS n, any_value(length(lab)) AS t FROM (
  SELECT msg_id, url, split_part(host, '.', 1) AS lab, unnest(string_split(split_part(host, '.', 1), '')) AS ch FROM u1) GROUP BY msg_id, url, ch) GROUP BY msg_id, url),
lf AS (SELECT msg_id, count(*) AS n, count(DISTINCT {LAST2}) AS domains, bool_or({is_ip('host')}) AS ip, bool_or(contains(netloc, '@')) AS at_,
  bool_or({one_of('host', D.ML_SHORTENERS)}) AS short, avg(({one_of(LAST1, D.ML_ABUSED_TLDS)})::INT) AS tld, bool_or(contains(host, 'xn--')) AS puny,
  max(length(url)) AS longest, max(length(host) - length(replace(host, '.', ''))) AS depth,
  avg(regexp_matches(url_decode(url), {s(D.ML_CREDENTIAL_PATH)})::INT) AS cred, bool_or(regexp_matches(url, '%[0-9a-fA-F]{{2}}')) AS enc, max(entropy) AS entropy
  FROM u1 LEFT JOIN ent USING (msg_id, url) GROUP BY msg_id),
am AS (SELECT msg_id, bool_or(shown <> '' AND host <> '' AND array_to_string(string_split(shown, '.')[-2:], '.') <> {LAST2}) AS mismatch FROM (
  SELECT msg_id, shown, {HOST} AS host FROM (SELECT msg_id, lower(regexp_extract(coalesce(anchor_text, ''), {s(D.ML_DOMAIN_IN_TEXT)}, 1)) AS shown,
    regexp_extract(url, '(?i)^[a-z]+://([^/?#]*)', 1) AS netloc FROM message_links WHERE source = 'anchor')) GROUP BY msg_id),
ff AS (SELECT msg_id, count(*) AS files, bool_or({one_of("lower(string_split(filename, '.')[-1])", D.ML_DANGEROUS_EXT)}) AS danger,
  bool_or({one_of("lower(string_split(filename, '.')[-1])", D.ML_DANGEROUS_EXT)} AND length(filename) - length(replace(filename, '.', '')) >= 2) AS double_ext
  FROM message_files GROUP BY msg_id),
bf AS (SELECT msg_id, {BODY_SQL} FROM messages),
fea AS (SELECT b.msg_id, """
_V = {
    "url_count_log": "ln(1 + coalesce(n, 0))", "unique_domain_count": "least(coalesce(domains, 0), 20)", "ip_url": "coalesce(ip, false)::INT",
    "at_symbol_url": "coalesce(at_, false)::INT", "shortener_url": "coalesce(short, false)::INT", "suspicious_tld_ratio": "coalesce(tld, 0)",
    "punycode_domain": "coalesce(puny, false)::INT", "max_url_length_log": "ln(1 + coalesce(longest, 0))", "max_subdomain_depth": "least(coalesce(depth, 0), 8)",
    "credential_path_ratio": "coalesce(cred, 0)", "encoded_url": "coalesce(enc, false)::INT", "anchor_domain_mismatch": "coalesce(mismatch, false)::INT",
    "max_hostname_entropy": "coalesce(entropy, 0)", "form_present": "(form_count > 0)::INT", "password_input": "(password_forms > 0)::INT",
    "hidden_elements": "least(hidden_count, 10)", "script_present": "(script_count > 0)::INT", "attachment_count": "least(coalesce(files, 0), 10)",
    "dangerous_attachment": "coalesce(danger, false)::INT", "double_extension_attachment": "coalesce(double_ext, false)::INT",
    "body_length_log": "ln(1 + chars)", "uppercase_ratio": "CASE WHEN letters > 0 THEN upper / letters ELSE 0 END", "exclamation_rate": "bangs / words",
    "urgency_terms": "least(urgency, 10)", "credential_terms": "least(credential, 10)"}
FEA += ", ".join(f"round(({_V[n]})::DOUBLE, 6) AS {n}" for n in D.STRUCTURAL_FEATURES) + """
  FROM bf b JOIN html_counts h USING (msg_id) LEFT JOIN lf USING (msg_id) LEFT JOIN am USING (msg_id) LEFT JOIN ff USING (msg_id))"""


def features(spark, d):
    def build():
        m = fx.messages(spark, d).selectExpr(
            "msg_id", "text", f"size({form_array('html')}) AS form_count", f"size(filter({form_array('html')}, f -> f.password)) AS password_forms",
            f"size({concealed_texts('html')}) AS hidden_count", f"{count_of('html', 'script')} AS script_count")
        return structural(m, fx.message_links(spark, d), fx.message_files(spark, d))
    return table_once(spark, f"features_{d}", build)


@query("fea1_structural_features", FEA + " SELECT * FROM fea")
def fea1(spark, d):
    return features(spark, d)


@query("fea2_char_stats", f"""SELECT doc_id AS msg_id, chars::BIGINT AS chars, letters::BIGINT AS letters, upper::BIGINT AS upper, words::BIGINT AS words,
  bangs::BIGINT AS bangs, urgency::BIGINT AS urgency, credential::BIGINT AS credential FROM (SELECT doc_id, {BODY_SQL} FROM documents)""")
def fea2(spark, d):
    return body_features(fx.table(spark, d, "documents").selectExpr("doc_id AS msg_id", "text")).drop("text")


# ------------------------------------------------------------------ feature blocks
WORD_SQL = BASE + """,
ws AS (SELECT doc, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+'), lambda w: regexp_matches(w, '^[a-z][a-z0-9'']+$')) AS w FROM firsts),
terms AS (SELECT doc, unnest(w) AS term FROM ws UNION ALL SELECT doc, unnest(list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1])) FROM ws)"""
CHAR_SQL = BASE + """,
cw AS (SELECT doc, ' '||unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))||' ' AS p FROM firsts),
terms AS (SELECT doc, substring(p, i, 3) AS term FROM (SELECT doc, p, unnest(range(1, greatest(length(p) - 2, 1) + 1)) AS i FROM cw)
  UNION ALL SELECT doc, substring(p, i, 4) FROM (SELECT doc, p, unnest(range(1, greatest(length(p) - 3, 1) + 1)) AS i FROM cw WHERE length(p) > 3)
  UNION ALL SELECT doc, substring(p, i, 5) FROM (SELECT doc, p, unnest(range(1, greatest(length(p) - 4, 1) + 1)) AS i FROM cw WHERE length(p) > 4))"""


def _vocab_sql(base, min_df, max_df):
    return base + f""", n AS (SELECT count(*) AS n FROM firsts), tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL),
v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT n FROM n)
  ORDER BY total DESC, term LIMIT 40000)
SELECT term AS name, df::BIGINT AS df, round(ln((1 + (SELECT n FROM n)) / (1 + df)) + 1, 6)::DOUBLE AS idf FROM v"""


@query("ml1_word_tfidf", _vocab_sql(WORD_SQL, 3, 0.9))
def ml1(spark, d):
    return vocabulary(kept_texts(spark, d), "word").selectExpr("name", "df", "round(idf, 6) AS idf")


@query("ml2_char_tfidf", _vocab_sql(CHAR_SQL, 5, 1.0))
def ml2(spark, d):
    return vocabulary(kept_texts(spark, d), "char").selectExpr("name", "df", "round(idf, 6) AS idf")


@query("ml3_scale_clip", FEA + """,
long AS (UNPIVOT fea ON COLUMNS(* EXCLUDE (msg_id)) INTO NAME name VALUE x), st AS (SELECT name, avg(x) AS mean, stddev_pop(x) AS std FROM long GROUP BY name)
SELECT msg_id AS doc, name, round(least(5, greatest(-5, CASE WHEN std > 0 THEN (x - mean) / std ELSE x - mean END)), 4) + 0.0::DOUBLE AS value FROM long JOIN st USING (name)""")
def ml3(spark, d):
    f = features(spark, d).withColumnRenamed("msg_id", "doc")
    return scaled(f, scaling(f)).selectExpr("doc", "name", "round(value, 4) + 0.0D AS value")


# ------------------------------------------------------------------ training
_trained: dict = {}


def inputs(spark, d):
    """(texts, structural features, y and split per document) of the prepared corpus."""
    def build():
        g = groups(spark, d).join(splits(spark, d).select("group", "split"), "group").select("doc", "label", "split")
        return g.selectExpr("doc", "int(label = 'phishing') AS y", "split")
    texts = kept_texts(spark, d).select("doc", "text")
    return texts, features(spark, d).withColumnRenamed("msg_id", "doc"), table_once(spark, f"labelled_{d}", build)


def trained(spark, d, key, rounds=300):
    """Fitted candidate and its labelled vectors, trained once per application."""
    k = (spark.sparkContext.applicationId, d, key, rounds)
    if k not in _trained:
        texts, feats, y = inputs(spark, d)
        kinds = C.CANDIDATES[key][2]
        ks = (k[0], d, "space", kinds)
        if ks not in _trained:
            train_ids = y.where("split = 'train'").select("doc")
            space = FeatureSpace.fit(membership(texts, train_ids, "left_semi"), feats.join(train_ids, "doc", "left_semi"), kinds)
            _trained[ks] = (space, space.vectors(texts.join(y, "doc"), feats))
        space, vectors = _trained[ks]
        _trained[k] = (C.fit(key, space, vectors.where("split = 'train'"), rounds), vectors)
    return _trained[k]


@query("ml4_assemble")
def ml4(spark, d):
    """Size and fill of the assembled vectors."""
    from pyspark.ml.functions import vector_to_array
    fitted, vectors = trained(spark, d, "lr_hybrid")
    return vectors.select("doc", F.expr("y"), F.size(F.filter(vector_to_array("features"), lambda v: v != 0)).alias("non_zero"),
                          F.lit(fitted.space.size).alias("size"))


def _evaluate(name, key):
    @query(name)
    def run(spark, d):
        return spark.createDataFrame([evaluated(spark, d, key)], C.RESULT)


_evaluate("ml5_logreg", "lr_words")
_evaluate("ml5_logreg_text", "lr_text")
_evaluate("ml5_logreg_hybrid", "lr_hybrid")
_evaluate("ml6_linear_svm_calibrated", "svm_hybrid")
_evaluate("ml7_complement_nb", "nb_words")
_evaluate("ml8_gbm", "gbm_structural")


@query("ml9_prior_gate")
def ml9(spark, d):
    """Structural weights of the hybrid model that contradict the priors."""
    return C.prior_violations(trained(spark, d, "lr_hybrid")[0].weights())


_rows: dict = {}


def evaluated(spark, d, key):
    """Validation row of a candidate, computed once per application; the tuned threshold is its last field."""
    k = (spark.sparkContext.applicationId, d, key)
    if k not in _rows:
        fitted, vectors = trained(spark, d, key)
        _rows[k] = C.evaluation_row(fitted, vectors.where("split = 'validation'"))
    return _rows[k]


def tuned(spark, d, key) -> float:
    return evaluated(spark, d, key)[-1]


def _results(spark, d):
    """All candidates on the validation split."""
    return spark.createDataFrame([evaluated(spark, d, key) for key in C.CANDIDATES], C.RESULT)


@query("ml10_select_model")
def ml10(spark, d):
    return C.select_best(_results(spark, d))


# ------------------------------------------------------------------ metrics
PTS = with_("scored") + """,
g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY score),
pts AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


def _points(spark, d):
    return metrics.roc_points(fx.labelled_scores(spark, d))


@query("ml11_roc_points", PTS + "SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM pts")
def ml11(spark, d):
    return _points(spark, d).select("score", "tp", "fp")


@query("ml12_threshold_at_fpr", PTS + "SELECT least(coalesce(min(score) + 1e-9, 1.0), 1.0)::DOUBLE AS threshold FROM pts WHERE fp / n <= 0.01")
def ml12(spark, d):
    return metrics.threshold_for_fpr(_points(spark, d), D.MAX_FPR)


@query("ml13_recall_at_fpr", PTS + "SELECT coalesce(max(tp / p), 0)::DOUBLE AS recall FROM pts WHERE fp / n <= 0.01")
def ml13(spark, d):
    return metrics.recall_at_fpr(_points(spark, d), D.MAX_FPR)


@query("ml14_class_metrics", with_("scored") + """,
c AS (SELECT count(*) FILTER (WHERE score >= 0.55 AND y = 1) AS tp, count(*) FILTER (WHERE score >= 0.55 AND y = 0) AS fp,
  count(*) FILTER (WHERE score < 0.55 AND y = 0) AS tn, count(*) FILTER (WHERE score < 0.55 AND y = 1) AS fn FROM scored),
r AS (SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM c)
SELECT tp, fp, tn, fn, precision, recall, round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy, round(fp / (fp + tn), 4) AS false_positive_rate,
  round(fn / (fn + tp), 4) AS false_negative_rate, round(2 * precision * recall / (precision + recall), 4) AS f1 FROM r""")
def ml14(spark, d):
    return metrics.class_metrics(fx.labelled_scores(spark, d), 0.55)


@query("ml15_roc_auc", PTS + "SELECT round(sum(pos * (n - fp + neg / 2)) / any_value(p * n), 4)::DOUBLE AS roc_auc FROM pts")
def ml15(spark, d):
    return metrics.curve_areas(_points(spark, d)).select("roc_auc")


@query("ml16_avg_precision", PTS + "SELECT round(sum(pos / p * tp / (tp + fp)), 4)::DOUBLE AS pr_auc FROM pts")
def ml16(spark, d):
    return metrics.curve_areas(_points(spark, d)).select("pr_auc")


@query("ml17_hard_errors", with_("scored") + """
SELECT doc_id, CASE WHEN y = 1 THEN 'phishing' ELSE 'legitimate' END AS label, round(score, 4) AS score FROM scored
WHERE (score >= 0.55) <> (y = 1) ORDER BY abs(round(score, 4) - 0.55) DESC, doc_id LIMIT 40""")
def ml17(spark, d):
    return metrics.hard_errors(fx.labelled_scores(spark, d), 0.55, "doc_id")


# ------------------------------------------------------------------ use of a model
@query("ml18_challenge_eval")
def ml18(spark, d):
    """Score and predicted label of every benchmark text."""
    from ..functions.text import normalise
    fitted, _ = trained(spark, d, "lr_text")
    texts = fx.table(spark, d, "benchmark").selectExpr("item_id AS doc", f"{normalise(chr(39) * 2, 'text')} AS text")
    return fitted.score(fitted.space.vectors(texts, None)).selectExpr(
        "doc AS item_id", "round(score, 4) AS probability", f"IF(score >= {tuned(spark, d, 'lr_text')}D, 'phishing', 'legitimate') AS predicted")


@query("ml19_global_weights")
def ml19(spark, d):
    return C.top_weights(trained(spark, d, "lr_text")[0].weights())


@query("ml20_batch_score")
def ml20(spark, d):
    from ..functions.text import alpha_tokens
    from ..operators.terms import coverage
    fitted, vectors = trained(spark, d, "lr_text")
    texts = kept_texts(spark, d)
    words = fitted.space.vocab.where("kind = 'word'").selectExpr("name AS term")
    cov = coverage(texts.selectExpr("doc", f"{alpha_tokens('text', 2)} AS terms"), words, "doc", few=True)
    scored = fitted.score(vectors).select("doc", "score").join(cov, "doc").join(texts.selectExpr("doc", "length(text) AS chars"), "doc")
    return C.assess(scored, tuned(spark, d, "lr_text"))


def _contribs(spark, d):
    fitted, _ = trained(spark, d, "lr_hybrid")
    texts, feats, _ = inputs(spark, d)
    return fitted, C.contributions(fitted.space, texts, feats, fitted.weights())


@query("ml21_explain")
def ml21(spark, d):
    return C.explain(_contribs(spark, d)[1])


@query("ml22_explain_check")
def ml22(spark, d):
    """Contributions plus intercept equal the log-odds for every document."""
    fitted, contribs = _contribs(spark, d)
    total = contribs.selectExpr("doc", "total AS c")
    scored = fitted.score(trained(spark, d, "lr_hybrid")[1]).select("doc", "score").join(total, "doc", "left")
    return scored.selectExpr(f"abs(coalesce(c, 0.0D) + {fitted.model.intercept}D - ln(score / (1 - score))) < 1e-6 AS exact").groupBy("exact").agg(
        F.count("*").alias("n"))


@query("snk7_model_registry")
def snk7(spark, d):
    """Two versions saved; the newest is read back and scores."""
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/models_{d.strip('/').replace('/', '_')}"
    fitted, vectors = trained(spark, d, "lr_words")
    limit = tuned(spark, d, "lr_words")
    report = metrics.class_metrics(fitted.score(vectors.where("split = 'test'")), limit)
    for version in ("1.0.0", "1.0.1"):
        R.save(root, version, fitted, limit, vectors.where("split = 'train'").count(), report)
    again, threshold = R.load(spark, root)
    n = again.score(vectors).where(F.col("score") >= threshold).count()
    return R.latest(spark, root).selectExpr("version", "candidate", "threshold", "training_rows", f"{n}L AS flagged")


@query("snk8_eval_report")
def snk8(spark, d):
    """Candidate table and test metrics, written and read back."""
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/report_{d.strip('/').replace('/', '_')}"
    _results(spark, d).write.mode("overwrite").json(f"{root}/candidates")
    fitted, vectors = trained(spark, d, "lr_words")
    metrics.class_metrics(fitted.score(vectors.where("split = 'test'")), tuned(spark, d, "lr_words")).write.mode("overwrite").json(f"{root}/test")
    return spark.read.schema(C.RESULT).json(f"{root}/candidates").select("candidate", "eligible", "recall_at_fpr", "roc_auc", "pr_auc")
