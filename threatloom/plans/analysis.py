"""From raw messages to verdicts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dimensions as D
from .. import fixtures as fx
from ..functions import attachments as A
from ..functions import headers as H
from ..functions.hosts import clean_host, host_dimension, official_brand, registrable
from ..functions.html import concealed_texts, count_of, form_array
from ..functions.sqltext import one_of, q
from ..operators import detectors, intents, links, reputation, scoring
from ..operators.joins import lookup


def header_facts(messages: DataFrame) -> DataFrame:
    """Sender, routing and authentication columns from the header block. No shuffle."""
    addresses = q(r"""[^\s<>,;"]+@[^\s<>,;"]+""")
    df = messages.selectExpr("*", f"{H.header_array('header_block')} AS headers")
    df = df.selectExpr(
        "*", f"{H.first_of('headers', 'from')} AS _from", f"size({H.values_of('headers', 'from')}) AS from_count",
        f"transform(regexp_extract_all(coalesce({H.first_of('headers', 'reply-to')}, ''), {addresses}, 0), a -> lower(a)) AS reply_to",
        f"{H.return_path(H.first_of('headers', 'return-path'))} AS return_path",
        f"{H.first_of('headers', 'message-id')} AS message_id",
        f"coalesce({H.first_of('headers', 'x-mailer')}, {H.first_of('headers', 'user-agent')}) AS mailer",
        f"{H.parse_date(H.first_of('headers', 'date'))} AS date", f"{H.values_of('headers', 'received')} AS _received")
    df = H.with_received_chain(df, "_received").drop("_received")
    df = df.selectExpr("*", f"{H.mailbox_name('_from')} AS from_name", f"{H.mailbox_address('_from')} AS from_address")
    df = df.selectExpr("*", f"{H.domain_of('from_address')} AS from_domain").drop("_from")
    df = df.selectExpr(
        "*", f"IF(from_domain <> '', {registrable(clean_host('from_domain'))}, NULL) AS from_org",
        f"coalesce({H.domain_of('try_element_at(reply_to, 1)')}, '') AS reply_domain",
        f"exists(reply_to, a -> {H.domain_of('a')} <> coalesce(from_domain, '')) AS reply_elsewhere",
        f"coalesce({H.domain_of('return_path')}, '') AS return_domain")
    df = df.selectExpr("*", f"{official_brand('from_org')} AS sender_brand",
                       f"coalesce({one_of('from_org', D.FREE_MAIL)}, false) AS sender_free_mail")
    return H.auth_summary(df)


def message_facts(messages: DataFrame) -> DataFrame:
    """Narrow row per message: header facts, phrase scores, HTML counts. The body is read once and left behind."""
    df = header_facts(messages)
    df = df.selectExpr(
        "*", f"text RLIKE {q(D.MOBILE_SIGNATURE)} AS mobile_signature",
        "sha2(concat(header_block, '\\r\\n\\r\\n', text), 256) AS message_sha256",
        "bigint(octet_length(header_block) + octet_length(text) + 4) AS size_bytes")
    df = df.selectExpr("*", f"{count_of('html', 'script')} AS script_count", f"size({concealed_texts('html')}) AS hidden_count",
                       f"size({form_array('html')}) AS form_count", f"size(filter({form_array('html')}, f -> f.password)) AS password_forms")
    df = intents.raw_scores(df)
    return df.drop("text", "html", "headers", "header_block")


def file_facts(files: DataFrame) -> DataFrame:
    return A.analyse(files).groupBy("msg_id").agg(F.expr(
        "array_sort(collect_list(struct(pos, filename, extension, size, sha256, md5, risk_rank, indicators)))").alias("files"))


def with_sender(facts: DataFrame) -> DataFrame:
    """Add look-alike and script facts of the sender domain from the host dimension."""
    senders = host_dimension(facts.selectExpr("from_domain AS host")).selectExpr(
        "host AS _sender_host", "lookalike AS sender_lookalike", "mixed_script AS sender_mixed_script")
    facts = facts.selectExpr("*", f"{clean_host('from_domain')} AS _fd")
    return lookup(facts, senders, "_fd", "_sender_host", ["msg_id"]).drop("_sender_host", "_fd")


def gather(messages: DataFrame, candidates: DataFrame, files: DataFrame, scores: DataFrame) -> DataFrame:
    """Everything the rules look at, one row per message.

    Only narrow facts are shuffled: once by sender domain (salted), once by message id.
    """
    facts = with_sender(message_facts(messages))
    linked = links.per_message(links.analyse(links.dedup(candidates)))
    filed = file_facts(files)
    df = facts.join(linked, "msg_id", "left").join(filed, "msg_id", "left").join(scores, "msg_id", "left")
    df = df.withColumns({
        "links": F.coalesce("links", F.array().cast(linked.schema["links"].dataType)),
        "files": F.coalesce("files", F.array().cast(filed.schema["files"].dataType))})
    df = df.selectExpr("*", "exists(links, l -> l.source <> 'image') OR form_count > 0 AS call_to_action",
                       f"{scoring.model_confidence('probability', 'threshold')} AS model_confidence")
    return intents.in_context(df)


def investigate(messages: DataFrame, candidates: DataFrame, files: DataFrame, scores: DataFrame,
                feed: DataFrame | None = None) -> DataFrame:
    """One wide verdict row per message, with findings, links, files and hops nested."""
    df = detectors.run(gather(messages, candidates, files, scores))
    if feed is not None:
        ti = reputation.findings(reputation.hits(reputation.targets(df), reputation.latest(feed)))
        df = df.join(ti, "msg_id", "left")
        df = df.withColumn("findings", F.expr("IF(ti IS NULL, findings, concat(findings, ti))")).drop("ti")
    return scoring.score(df)


def corpus_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole derived corpus through the whole engine."""
    return investigate(fx.messages(spark, sf_dir), fx.message_links(spark, sf_dir), fx.message_files(spark, sf_dir),
                       fx.model_scores(spark, sf_dir), fx.dim(spark, "dim_reputation"))
