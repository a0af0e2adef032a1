"""Feature space: TF-IDF of words and characters plus scaled structural features.

Texts are cut into tokens by the JVM; Arrow batches of token lists are counted
with NumPy, so no term of a text becomes a row of its own.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .. import dimensions as D
from ..functions.sqltext import q
from ..functions.text import blank_words
from ..sources.shared import checkpointed, rows_a_batch

MAX_FEATURES, CLIP = 40000, 5.0
SIZES = (3, 4, 5)
#: Texts of a batch, rows of a table of counts over the whole vocabulary, and terms or tokens that a task holds.
BATCH, ROWS, HELD = 256, 32, 500_000

_WORD = q(r"(?<![\p{L}\p{N}_])([a-z][a-z0-9']+)(?![\p{L}\p{N}_])")
#: What a text is cut into, and the limits of document frequency.
TOKENS = {"word": f"regexp_extract_all(lower(text), {_WORD}, 1)", "char": blank_words("text")}
LIMITS = {"word": (3, 0.9), "char": (5, 1.0)}


def token_grams(token: str) -> list[str]:
    """Character grams of one token, as ``char_wb_grams`` cuts them."""
    w = f" {token} "
    return [w[i:i + n] for k, n in enumerate(SIZES) if not k or len(w) > SIZES[k - 1] for i in range(max(len(w) - n + 1, 1))]


class Numbered:
    """Numbers of terms; -1 for a term that is unknown where none is added."""

    def __init__(self, terms: list[str] = (), grows: bool = False):
        self.at, self.grows = {t: i for i, t in enumerate(terms)}, grows
        self.tokens: dict = {}

    def __call__(self, terms: list[str]) -> np.ndarray:
        at = self.at
        return np.array([at.setdefault(t, len(at)) for t in terms] if self.grows else [at.get(t, -1) for t in terms], np.int64)

    def grams(self, token: str) -> np.ndarray:
        """The known grams of a token; those of a token seen before are not made again."""
        known = self.tokens.get(token)
        if known is None:
            known = self(token_grams(token))
            known = self.tokens[token] = known[known >= 0]
        return known

    def trim(self) -> None:
        if len(self.tokens) > HELD:
            self.tokens.clear()


def occurrences(kind: str, column: pa.Array, number: Numbered) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and count of the terms of a column of token lists; a row may name a term more than once."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy()
    coded = column.flatten().dictionary_encode()
    rows, codes, tokens = np.repeat(np.arange(len(column)), lengths), coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    if not len(tokens):
        return rows, codes, codes
    if kind == "word":
        next_ = np.flatnonzero(rows[1:] == rows[:-1])
        pairs, back = np.unique(codes[next_] * len(tokens) + codes[next_ + 1], return_inverse=True)
        two = number([f"{tokens[a]} {tokens[b]}" for a, b in zip(*(x.tolist() for x in divmod(pairs, len(tokens))))])[back]
        terms = np.concatenate((number(tokens)[codes], two))
        rows = np.concatenate((rows, rows[next_]))
        return rows[terms >= 0], terms[terms >= 0], np.ones(int((terms >= 0).sum()), np.int64)
    cells, n = np.unique(rows * len(tokens) + codes, return_counts=True)
    row, code = divmod(cells, len(tokens))
    parts = [number.grams(t) for t in tokens]
    sizes = np.array([len(x) for x in parts])
    starts, taken = np.cumsum(sizes) - sizes, sizes[code]
    at = np.arange(taken.sum()) + np.repeat(starts[code] - (np.cumsum(taken) - taken), taken)
    return np.repeat(row, taken), np.concatenate(parts)[at], np.repeat(n, taken)


COUNTS = pa.schema([("term", pa.string()), ("df", pa.int64()), ("total", pa.int64())])


def _counting(kind: str):
    """Document frequencies and totals of the terms of a task; the table is handed on when it holds many terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, df, total = Numbered(grows=True), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def table():
            return pa.RecordBatch.from_arrays([pa.array(list(number.at), pa.string()), pa.array(df), pa.array(total)], schema=COUNTS)
        for batch in batches:
            rows, terms, n = occurrences(kind, batch.column("tokens"), number)
            size = len(number.at)
            df, total = (np.concatenate((x, np.zeros(size - len(x), np.int64))) for x in (df, total))
            df += np.bincount(np.unique(rows * max(size, 1) + terms) % max(size, 1), minlength=size)
            total += np.bincount(terms, n, size).astype(np.int64)
            if size > HELD or len(number.tokens) > HELD:
                yield table()
                number, df, total = Numbered(grows=True), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if number.at:
            yield table()
    return run


def vocabulary(texts: DataFrame, kind: str) -> DataFrame:
    """kind, name, df, idf of the most frequent terms, stored; at most MAX_FEATURES rows, so it may be broadcast."""
    min_df, max_df = LIMITS[kind]
    n = texts.agg(F.count("*").alias("n")).scalar()
    counts = texts.selectExpr(f"{TOKENS[kind]} AS tokens").mapInArrow(_counting(kind), "term string, df bigint, total bigint").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("total").alias("total"))
    kept = counts.withColumn("n", n).where(f"df >= {min_df} AND df <= {max_df}D * n")
    with rows_a_batch(texts.sparkSession, BATCH):
        return checkpointed(kept.orderBy(F.desc("total"), "term").limit(MAX_FEATURES).selectExpr(
            f"'{kind}' AS kind", "term AS name", "df", "ln((1 + n) / (1 + df)) + 1 AS idf"))


def scaling(features: DataFrame) -> DataFrame:
    """name, mean, std (population) of the structural features; one row per feature."""
    long = features.selectExpr("doc", f"stack({len(D.STRUCTURAL_FEATURES)}, " + ", ".join(
        f"'{n}', {n}" for n in D.STRUCTURAL_FEATURES) + ") AS (name, x)")
    return long.groupBy("name").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def scaled(features: DataFrame, scale: DataFrame) -> DataFrame:
    """doc, kind, name, value: standardised and clipped."""
    long = features.selectExpr("doc", f"stack({len(D.STRUCTURAL_FEATURES)}, " + ", ".join(
        f"'{n}', {n}" for n in D.STRUCTURAL_FEATURES) + ") AS (name, x)")
    return long.join(F.broadcast(scale), "name").selectExpr(
        "doc", "'structural' AS kind", "name", f"least({CLIP}D, greatest(-{CLIP}D, IF(std > 0, (x - mean) / std, x - mean))) AS value")


def scaled_array(features: DataFrame, scale: DataFrame, order: list[str]) -> DataFrame:
    """doc, structural: the values of ``scaled`` in one array."""
    known = {r["name"]: r for r in scale.collect()}  # one row for each structural feature

    def value(n):
        x, mean, std = F.col(n), F.lit(known[n]["mean"]).cast("double"), F.lit(known[n]["std"]).cast("double")
        return F.least(F.lit(CLIP), F.greatest(F.lit(-CLIP), F.when(std > 0, (x - mean) / std).otherwise(x - mean)))
    return features.select("doc", F.array(*[value(n) for n in order]).alias("structural"))


def term_counts(kinds: dict, batch: pa.RecordBatch, number: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and count of the known terms of a batch of token lists, in the order of rows and columns."""
    found = []
    for kind, (names, columns, _) in kinds.items():
        if kind != "structural" and len(names):
            for start in range(0, batch.num_rows, ROWS):
                part = batch.column(kind).slice(start, ROWS)
                rows, terms, n = occurrences(kind, part, number[kind])
                tf = np.bincount(rows * len(names) + terms, n, len(part) * len(names))
                cells = np.flatnonzero(tf)
                r, c = divmod(cells, len(names))
                found.append((r + start, columns[c], tf[cells].astype(np.int64)))
            number[kind].trim()
    return in_order(found)


def in_order(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, columns, values = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64) for _ in range(3))
    order = np.lexsort((columns, rows))
    return rows[order], columns[order], values[order]


def valued(kinds: dict, rows: np.ndarray, columns: np.ndarray, tf: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the features of counted texts, in the order of rows and columns.

    TF-IDF is sublinear and has unit length for each kind.
    """
    size = sum(len(at) for _, at, _ in kinds.values())
    code, idf = np.zeros(size, np.int64), np.zeros(size)
    found = []
    for k, (kind, (names, at, own)) in enumerate(kinds.items()):
        code[at], idf[at] = k, own
        if kind == "structural":
            given = [i for i, x in enumerate(batch.column("structural")) if x.is_valid]
            x = np.array([batch.column("structural")[i].as_py() for i in given], np.float64).reshape(len(given), len(names))
            r, c = np.nonzero(~np.isnan(x) & (x != 0))
            found.append((np.array(given, np.int64)[r], at[c], x[r, c]))
    w = (1 + np.log(tf)) * idf[columns]
    part = rows * len(kinds) + code[columns]
    w = w / np.sqrt(np.bincount(part, w * w))[part] if len(w) else w
    return in_order([(rows[w != 0], columns[w != 0], w[w != 0]), *found])


def each_batch(kinds, make):
    """Applies make(kinds, batch, rows, columns, counts) to batches of token lists; kinds are broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {k: Numbered(names) for k, (names, _, _) in kinds.value.items()}
        for batch in batches:
            yield make(kinds.value, batch, *term_counts(kinds.value, batch, number))
    return run


def ends_of(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())


def _as_counts(_, batch, rows, columns, tf):
    """Columns as steps from the one before, small numbers that take few bits."""
    ends = ends_of(rows, batch.num_rows)
    steps = np.diff(columns, prepend=0)
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    steps[first] = columns[first]
    kept = [c for c in batch.schema.names if c not in ("word", "char")]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (steps, tf))],
                                      [*kept, "steps", "tf"])


def _as_vectors(kinds, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            n, steps = batch.num_rows, batch.column("steps")
            lengths = pc.list_value_length(steps).to_numpy()
            rows, ran = np.repeat(np.arange(n), lengths), np.cumsum(steps.flatten().to_numpy(), dtype=np.int64)
            before = np.concatenate(([0], ran))[np.cumsum(lengths) - lengths]
            rows, columns, values = valued(kinds.value, rows, ran - before[rows], batch.column("tf").flatten().to_numpy(), batch)
            ends = ends_of(rows, n)
            cells = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                     pa.ListArray.from_arrays(ends, pa.array(columns.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values.astype(np.float64)))]
            kept = [c for c in batch.schema.names if c not in ("steps", "tf", "structural")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.StructArray.from_arrays(cells, ["type", "size", "indices", "values"])],
                                             [*kept, "features"])
    return run


@dataclass
class FeatureSpace:
    """Fitted vocabulary and scaling; ``columns`` maps (kind, name) to a position."""
    kinds: tuple
    vocab: DataFrame
    scale: DataFrame | None
    columns: DataFrame
    size: int

    @classmethod
    def fit(cls, texts: DataFrame, features: DataFrame | None, kinds: tuple) -> "FeatureSpace":
        vocab = None
        for k in ("word", "char"):
            if k in kinds:
                one = vocabulary(texts, k)
                vocab = one if vocab is None else vocab.unionByName(one)
        names = vocab.select("kind", "name") if vocab is not None else None
        scale = None
        if "structural" in kinds:
            scale = checkpointed(scaling(features))
            s = scale.selectExpr("'structural' AS kind", "name")
            names = s if names is None else names.unionByName(s)
        # bounded by 2 * MAX_FEATURES + 25 rows
        columns = checkpointed(names.selectExpr("kind", "name", "int(row_number() OVER (ORDER BY kind DESC, name)) - 1 AS idx"))
        return cls(tuple(kinds), vocab, scale, columns, columns.count())

    def parts(self) -> dict:
        """(names, columns, idf) of each kind, by column; at most 2 * MAX_FEATURES + 25 rows pass the driver."""
        idf = self.vocab.select("kind", "name", "idf") if self.vocab is not None else self.columns.selectExpr("kind", "name", "1.0D AS idf").limit(0)
        rows = self.columns.join(idf, ["kind", "name"], "left").orderBy("idx").toArrow().to_pylist()
        out = {}
        for k in self.kinds:
            own = [r for r in rows if r["kind"] == k]
            out[k] = ([r["name"] for r in own], np.array([r["idx"] for r in own], np.int64), np.array([r["idf"] or 0.0 for r in own], np.float64))
        return out

    def tokens(self, texts: DataFrame, features: DataFrame | None, parts: dict, how: str) -> DataFrame:
        """texts without their text, with what each kind is made from; nothing for a text without doc."""
        cut = [f"IF(doc IS NULL, NULL, {TOKENS[k]}) AS {k}" for k in self.kinds if k in TOKENS]
        kept = [c for c in texts.columns if c != "text"]
        if "structural" not in self.kinds:
            return texts.selectExpr(*kept, *cut)
        own = features.dropDuplicates(["doc"]) if how == "left" else features
        return texts.join(scaled_array(own, self.scale, parts["structural"][0]), "doc", how).selectExpr(*kept, *cut, "structural")

    def mapped(self, texts: DataFrame, features: DataFrame | None, make, schema, how: str = "left") -> tuple:
        """make over the counted terms of texts, stored, and the broadcast kinds; a full join also takes features that have no text."""
        spark, parts = texts.sparkSession, self.parts()
        known = spark.sparkContext.broadcast(parts)
        with rows_a_batch(spark, BATCH):
            return checkpointed(self.tokens(texts, features, parts, how).mapInArrow(each_batch(known, make), schema)), known

    def vectors(self, texts: DataFrame, features: DataFrame | None) -> DataFrame:
        """texts without their text and with features (sparse vector); documents without a known feature get an empty vector.

        Counts of terms are stored, which take a fraction of the room of vectors; vectors are made from them where they are read.
        """
        kept = [f for f in texts.schema.fields if f.name != "text"]
        scaled = [StructField("structural", ArrayType(DoubleType()))] if "structural" in self.kinds else []
        counts = [StructField(c, ArrayType(IntegerType())) for c in ("steps", "tf")]
        stored, known = self.mapped(texts, features, _as_counts, StructType([*kept, *scaled, *counts]))
        return stored.mapInArrow(_as_vectors(known, self.size), StructType([*kept, StructField("features", VectorUDT())]))
