"""Structural model inputs of a message."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dimensions as D
from .hosts import is_ip
from .sqltext import one_of, q
from .text import entropy_bits
from .urls import full_url, written_host


def link_features(links: DataFrame) -> DataFrame:
    """Per message: numbers over distinct web links, from candidates(msg_id, source, url, anchor_text)."""
    tail, web = q(r"[.,;:!?]+$"), q(r"^(?i)(?:https?://|www\.)")
    urls = links.where("source IN ('anchor', 'text')").selectExpr("msg_id", f"regexp_replace(trim(url), {tail}, '') AS url").where(
        f"url RLIKE {web}").distinct()
    urls = urls.selectExpr("*", f"regexp_extract({full_url('url')}, '^(?i)[a-z]+://([^/?#]*)', 1) AS netloc").selectExpr(
        "*", f"{written_host('netloc')} AS host")
    urls = urls.selectExpr("*", f"{entropy_bits('substring_index(host, ' + q('.') + ', 1)')} AS entropy")
    decoded = "coalesce(try_url_decode(replace(url, '+', '%2B')), url)"
    per = urls.groupBy("msg_id").agg(
        F.count("*").alias("n"), F.count_distinct(F.expr("IF(host <> '', substring_index(host, '.', -2), NULL)")).alias("domains"),
        F.max(F.expr(is_ip("host"))).alias("ip"), F.max(F.expr("contains(netloc, '@')")).alias("at"),
        F.max(F.expr(one_of("host", D.ML_SHORTENERS))).alias("short"),
        F.avg(F.expr(f"IF(host <> '', double({one_of(chr(115) + 'ubstring_index(host, ' + q('.') + ', -1)', D.ML_ABUSED_TLDS)}), NULL)")).alias("tld"),
        F.max(F.expr("contains(host, 'xn--')")).alias("puny"), F.max(F.expr("length(url)")).alias("longest"),
        F.max(F.expr("length(host) - length(replace(host, '.', ''))")).alias("depth"),
        F.avg(F.expr(f"double({decoded} RLIKE {q(D.ML_CREDENTIAL_PATH)})")).alias("cred"),
        F.max(F.expr("url RLIKE '%[0-9a-fA-F]{2}'")).alias("enc"), F.max("entropy").alias("entropy"))
    shown = f"lower(regexp_extract(coalesce(anchor_text, ''), {q(D.ML_DOMAIN_IN_TEXT)}, 1))"
    anchors = links.where("source = 'anchor'").selectExpr("msg_id", f"{shown} AS shown", f"regexp_extract({full_url('url')}, '^(?i)[a-z]+://([^/?#]*)', 1) AS nl")
    anchors = anchors.selectExpr("msg_id", "shown", f"{written_host('nl')} AS host").groupBy("msg_id").agg(F.max(F.expr(
        "shown <> '' AND host <> '' AND substring_index(shown, '.', -2) <> substring_index(host, '.', -2)")).alias("mismatch"))
    return per.join(anchors, "msg_id", "full")


def file_features(files: DataFrame) -> DataFrame:
    bad = one_of("ext", D.ML_DANGEROUS_EXT)
    return files.selectExpr("msg_id", "lower(filename) AS f").selectExpr(
        "msg_id", "IF(contains(f, '.'), substring_index(f, '.', -1), NULL) AS ext", "length(f) - length(replace(f, '.', '')) AS dots").groupBy(
        "msg_id").agg(F.count("*").alias("files"), F.max(F.expr(f"coalesce({bad}, false)")).alias("danger"),
                      F.max(F.expr(f"coalesce({bad}, false) AND dots >= 2")).alias("double_ext"))


def body_features(bodies: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Character statistics and term counts of body text."""
    b = f"substring(text, 1, {max_chars})" if max_chars else "text"
    df = bodies.withColumn("_b", F.expr(b))
    return df.selectExpr(
        *bodies.columns, "length(_b) AS chars", f"length(regexp_replace(_b, {q('[^' + chr(92) + 'p{L}]')}, '')) AS letters",
        f"length(regexp_replace(_b, {q('[^' + chr(92) + 'p{Lu}]')}, '')) AS upper",
        f"greatest(1, size(filter(split(_b, {q(chr(92) + 's+')}), w -> w <> ''))) AS words",
        "length(_b) - length(replace(_b, '!', '')) AS bangs", f"regexp_count(_b, {q(D.ML_URGENCY)}) AS urgency",
        f"regexp_count(_b, {q(D.ML_CREDENTIAL)}) AS credential")


def structural(bodies: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """bodies(msg_id, text, form_count, password_forms, hidden_count, script_count) -> msg_id and the 25 features."""
    df = body_features(bodies).drop("text").join(link_features(links), "msg_id", "left").join(file_features(files), "msg_id", "left")

    def flag(c):
        return f"double(coalesce({c}, false))"
    values = {
        "url_count_log": "ln(1 + coalesce(n, 0))", "unique_domain_count": "double(least(coalesce(domains, 0), 20))",
        "ip_url": flag("ip"), "at_symbol_url": flag("at"), "shortener_url": flag("short"),
        "suspicious_tld_ratio": "coalesce(tld, 0.0D)", "punycode_domain": flag("puny"),
        "max_url_length_log": "ln(1 + coalesce(longest, 0))", "max_subdomain_depth": "double(least(coalesce(depth, 0), 8))",
        "credential_path_ratio": "coalesce(cred, 0.0D)", "encoded_url": flag("enc"), "anchor_domain_mismatch": flag("mismatch"),
        "max_hostname_entropy": "coalesce(entropy, 0.0D)", "form_present": flag("form_count > 0"), "password_input": flag("password_forms > 0"),
        "hidden_elements": "double(least(hidden_count, 10))", "script_present": flag("script_count > 0"),
        "attachment_count": "double(least(coalesce(files, 0), 10))", "dangerous_attachment": flag("danger"),
        "double_extension_attachment": flag("double_ext"), "body_length_log": "ln(1 + chars)",
        "uppercase_ratio": "IF(letters > 0, upper / letters, 0.0D)", "exclamation_rate": "bangs / words",
        "urgency_terms": "double(least(urgency, 10))", "credential_terms": "double(least(credential, 10))"}
    return df.selectExpr("msg_id", *[f"round({values[n]}, 6) AS {n}" for n in D.STRUCTURAL_FEATURES])
