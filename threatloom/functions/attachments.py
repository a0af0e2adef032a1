"""Attachment expressions and the archive listing function."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dimensions as D
from .sqltext import array_of, one_of, pick, q
from .urls import worst


def sanitise_filename(name: str) -> str:
    control, last, dots = q(r"[\x00-\x1f\x7f]"), q(r"([^\\/]*)$"), q(r"^\.+")
    base = f"trim(regexp_replace(regexp_extract(regexp_replace({name}, {control}, ''), {last}, 1), {dots}, ''))"
    return f"coalesce(nullif({base}, ''), 'unnamed')"


def extension_chain(name: str) -> str:
    dot = q(r"\.")
    parts = f"split(lower({name}), {dot})"
    return f"filter(slice({parts}, 2, greatest(size({parts}) - 1, 1)), x -> x RLIKE '^[a-z0-9]{{1,8}}$')"


def sniff_type(content: str) -> str:
    """Type by signature, or null."""
    head = f"hex(substring({content}, 1, 8))"
    cases = [(f"startswith({head}, '{mark}')", q(kind)) for mark, kind in D.SIGNATURES]
    cases.append((f"hex(substring({content}, {D.ISO_OFFSET + 1}, 5)) = '{D.ISO_MARK}'", q(D.ISO_TYPE)))
    cases.append((f"startswith({head}, '{D.LNK_MARK}')", q(D.LNK_TYPE)))
    start = f"lower(regexp_replace(decode(substring({content}, 1, 512), 'ISO-8859-1'), {q('^' + chr(92) + 's+')}, ''))"
    cases.append((" OR ".join(f"startswith({start}, {q(m)})" for m in D.HTML_STARTS), q("text/html")))
    return pick(cases)


@F.pandas_udf(T.ArrayType(T.StringType()))
def archive_entries(content: pd.Series) -> pd.Series:
    """Entry names of a ZIP from its directory; nothing is decompressed. Null stays null."""
    import io
    import zipfile

    def names(b):
        if b is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(b))) as z:
                return z.namelist()
        except Exception:
            return []

    return pd.Series([names(b) for b in content], dtype=object)


def analyse(files: DataFrame) -> DataFrame:
    """files(msg_id, pos, filename, content, declared_type) -> names, hashes, type, indicators, risk."""
    df = files.withColumnRenamed("filename", "raw_name").selectExpr(
        "* EXCEPT (content)", "coalesce(content, X'') AS content").selectExpr(
        "*", f"{sanitise_filename('raw_name')} AS filename", f"{sniff_type('content')} AS detected_type",
        "length(content) AS size", "sha2(content, 256) AS sha256", "md5(content) AS md5")
    df = df.selectExpr("*", f"{extension_chain('filename')} AS _chain",
                       "coalesce(startswith(detected_type, 'application/zip'), false) AS _zip")
    df = df.select("*", archive_entries(F.expr("IF(_zip, content, NULL)")).alias("archive_entries"))
    df = df.selectExpr("*", "coalesce(try_element_at(_chain, -1), '') AS extension",
                       "coalesce(try_element_at(_chain, -2), '') AS _prev",
                       f"transform(archive_entries, e -> coalesce(try_element_at({extension_chain('e')}, -1), '')) AS _inner")

    def ind(cond, name, severity):
        return f"CASE WHEN {cond} THEN named_struct('id', '{name}', 'severity', '{severity}') END"

    ext_exe, risky = one_of("extension", D.EXT_EXECUTABLE), one_of("e", D.EXT_EXECUTABLE + D.EXT_CONTAINER + D.EXT_MARKUP)
    pe = f"contains(detected_type, 'PE executable') AND NOT {ext_exe}"
    inds = array_of(
        ind(ext_exe, "executable", "critical"), ind(one_of("extension", D.EXT_CONTAINER), "disk_image", "high"),
        ind(one_of("extension", D.EXT_MACRO), "macro", "high"), ind(one_of("extension", D.EXT_MARKUP), "html_attachment", "high"),
        ind(f"{one_of('_prev', D.EXT_DECOY)} AND NOT {one_of('extension', D.EXT_DECOY)}", "double_extension", "critical"),
        ind("raw_name RLIKE '[‮‭‏]'", "rtlo", "critical"),
        f"coalesce({ind(pe, 'type_mismatch', 'critical')}, "
        + ind("extension = 'pdf' AND detected_type <> 'application/pdf'", "type_mismatch", "high") + ")",
        ind(one_of("extension", D.EXT_ARCHIVE), "archive", "low"),
        ind(f"exists(_inner, e -> {risky})", "archive_executable", "critical"), ind("size = 0", "empty", "info"))
    df = df.selectExpr("*", f"{inds} AS indicators")
    return df.selectExpr("msg_id", "pos", "raw_name", "filename", "extension", "declared_type", "detected_type", "size",
                         "sha256", "md5", "archive_entries", "indicators", f"{worst('indicators')} AS risk_rank")
