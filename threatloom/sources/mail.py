"""Raw mail files in, structured rows out."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dimensions as D

INGESTED = ("subject string, plain string, html string, attachments array<struct<filename: string, content_type: string, "
            "content: binary>>, parts array<struct<path: string, content_type: string, filename: string, size: long>>, "
            "warnings array<string>, parse_error string")


def scan(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Raw messages under root/<label>/<source>/**, by each source's file pattern; with ``max_bytes``, larger files are left out."""
    out = None
    for name, label, pattern, _ in D.CORPUS_SOURCES:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
                 .load(f"{root}/{label}/{name}").where(F.lit(True) if max_bytes is None else F.col("length") <= max_bytes)
                 .select(F.lit(name).alias("source"), F.lit(label).alias("label"), "path", "length", "content"))
        out = files if out is None else out.unionByName(files)
    return out


def registered_sources(spark: SparkSession, present: DataFrame) -> DataFrame:
    """Registry rows of the sources that occur in ``present(source)``."""
    from ..fixtures import inline_rows
    registry = inline_rows(spark, "source label pattern licence", D.CORPUS_SOURCES)
    return registry.join(present.select("source").distinct(), "source", "left_semi")


def _leaves(part, path="1"):
    """(path, part) of a message and everything inside it, in order, numbered as in a mail store."""
    yield path, part
    if part.is_multipart():
        for i, inner in enumerate(part.iter_parts(), 1):
            yield from _leaves(inner, f"{path}.{i}")


def _read(raw):
    """Subject, bodies, attachments, part list and warnings of one message."""
    import email
    from email import policy

    try:
        message = email.message_from_bytes(raw, policy=policy.default)
        bodies, files, listed, warnings = {"text/plain": [], "text/html": []}, [], [], []
        for path, part in _leaves(message):
            kind, name = part.get_content_type(), part.get_filename()
            warnings += [f"part {path}: {type(d).__name__}" for d in part.defects]
            payload = b"" if part.is_multipart() else part.get_payload(decode=True) or b""
            text = payload.decode(_charset(part), errors="replace")
            listed.append((path, kind, name, len(text)))
            if part.is_attachment() or name:
                files.append((name or "", kind, payload))
            elif kind in bodies and not part.is_multipart():
                bodies[kind].append(text)
        return dict(subject=str(message["subject"] or ""), plain="\n".join(bodies["text/plain"]), html="\n".join(bodies["text/html"]),
                    attachments=files, parts=listed, warnings=warnings, parse_error=None)
    except Exception as e:  # a mail that cannot be read is a row with its error, not a failed job
        return dict(subject="", plain="", html="", attachments=[], parts=[], warnings=[], parse_error=type(e).__name__)


def _charset(part):
    import codecs

    try:
        return codecs.lookup(part.get_content_charset() or "utf-8").name
    except LookupError:
        return "utf-8"


def ingest(raw: DataFrame, *keys: str) -> DataFrame:
    """Decode ``content`` of every row; a row that cannot be decoded carries ``parse_error`` instead of failing the job."""
    def run(batches):
        for pdf in batches:
            rows = pd.DataFrame([_read(bytes(c)) for c in pdf["content"]])
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), rows], axis=1)

    kept = raw.select(*keys, "content")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keys).schema.fields)
    return kept.mapInPandas(run, f"{schema}, {INGESTED}")


def split_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Prepared split as model input: text, structural, y, and the row's id, group and source."""
    label = F.create_map(*[x for k, v in D.LABELS.items() for x in (F.lit(k), F.lit(v))])
    schema = "id string, source string, label string, text string, structural array<double>, `group` string, split string"
    return spark.read.schema(schema).json(path).withColumn("y", F.element_at(label, F.col("label")))


def challenge_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Challenge rows rendered as minimal messages."""
    raw = spark.read.schema("id string, label string, subject string, body string").json(path)
    return raw.select("id", "label", "subject", F.format_string(
        "From: sender@example.com\nTo: analyst@example.org\nSubject: %s\nMIME-Version: 1.0\n"
        "Content-Type: text/plain; charset=utf-8\n\n%s\n", "subject", "body").alias("raw"))
