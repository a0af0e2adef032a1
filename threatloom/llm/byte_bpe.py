"""Byte-level BPE over Arrow batches: ids, character offsets, and back to bytes.

The vocabulary is a public file of ranks (a token's bytes in base64, its id), given
by path and never trained here. Byte-level means that every byte is written as
one printable character: the printable bytes of Latin-1 as themselves, the others
as the characters from U+0100 on. The merges are found again from the ranks: a
token's two parts are what is left of its bytes when all merges of lower rank are
done. The driver reads the file once; tasks get merges and vocabulary broadcast
and build the library's tokenizer from them.

A text is cut by the vocabulary's pattern, and each match is encoded apart. Long
texts go to the library in segments that end before a space after a visible ASCII
character, where no match of the pattern can reach across; so the memory of a task
is bounded by ``SEGMENT`` and the longest run without such a place.

Offsets are code points: a token reaches from the character of its first byte to
the one of its last byte, so parts of one character have equal offsets.

Decoding reverses the table: ids are looked up as bytes, end to end, whole batches
at a time. Characters whose bytes are split over tokens come out whole; in
``parts``, the text that each token completes, they belong to the token with
their last byte.

Defined results: null text is empty text; empty texts have no tokens; null ids
are no ids; ids outside of the vocabulary decode to U+FFFD, in ``text`` also bytes
that are no UTF-8; repeated rows repeat their result; an empty table gives no rows;
other columns are ignored; texts of any length are encoded whole.
"""

import base64
import codecs
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .common import pieces, read

#: Bytes of text that the library gets at once, about.
SEGMENT = 256 << 10
#: Tokens of a batch to decode, about.
TOKENS = 1 << 20
CUT = re.compile(r"(?<=[!-~])(?= )")
UNKNOWN = "�".encode()


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """Tokens as bytes by id, the merges in their order as pairs of ids, and the pattern that cuts texts."""

    tokens: dict[int, bytes]
    merges: list[tuple[int, int]]
    pattern: str


def parts_of(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is left of a token when all merges below its own rank are done, the lowest first."""
    parts, limit = [token[i:i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= limit:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def load_vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """Vocabulary of a file of ranks; by default the public one of 50 256 tokens and its pattern."""
    if path is None or pattern is None:
        import public_tokenizers
        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        parts = parts_of(token, ranks)
        if len(parts) != 2 or any(p not in ranks for p in parts):
            raise ValueError(f"{path}: no two tokens of lower rank make {token!r}")
        merges.append((ranks[parts[0]], ranks[parts[1]]))
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: a byte has no token")
    return Vocabulary({i: t for t, i in ranks.items()}, merges, pattern)


@lru_cache(maxsize=2)
def tokenizer_of(shared):
    """The library's tokenizer for a broadcast vocabulary; one a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    v, table = shared.value, byte_characters()
    names = {i: "".join([table[b] for b in token]) for i, token in v.tokens.items()}
    model = models.BPE(vocab={name: i for i, name in names.items()}, merges=[(names[a], names[b]) for a, b in v.merges])
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(v.pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def segments(text: str, limit: int = SEGMENT) -> list[str]:
    """A text in parts of about ``limit`` characters that are encoded apart with the same result."""
    out, start = [], 0
    while len(text) - start > limit:
        cut = CUT.search(text, start + limit)
        if not cut:
            break
        out.append(text[start:cut.start()])
        start = cut.start()
    return [*out, text[start:]]


@lru_cache(maxsize=2)
def byte_table(shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, and each id's start and number of them; one more entry for unknown ids."""
    tokens = shared.value.tokens
    rows = [tokens.get(i, UNKNOWN) for i in range(max(tokens) + 1)] + [UNKNOWN]
    lengths = np.array([len(t) for t in rows], dtype=np.int64)
    return np.frombuffer(b"".join(rows), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def bytes_of(ids: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens of ids end to end, and where each token's bytes end."""
    content, starts, lengths = table
    ids = np.where((ids < 0) | (ids >= len(starts)), len(starts) - 1, ids)
    n = lengths[ids]
    ends = np.cumsum(n)
    return content[np.repeat(starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def character_spans(ids: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in code points of the encoded text."""
    raw, ends = bytes_of(ids, table)
    at = np.cumsum((raw & 0xC0) != 0x80)  # the character, from 1, that a byte belongs to
    n = table[2][ids]
    return at[ends - n] - 1, at[ends - 1]


def _lists(values: np.ndarray, counts: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))


def _encoded(shared, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(shared)
        for batch in pieces(batches, limit=SEGMENT):
            ids, counts = [], []
            texts = [segments(t or "") for t in batch.column("text").to_pylist()]
            if len(texts) > 1:  # short ones together
                found = [np.array(e.ids, dtype=np.int32) for e in tokenizer.encode_batch_fast([s for t in texts for s in t], add_special_tokens=False)]
            else:
                found = [np.array(tokenizer.encode_batch_fast([s], add_special_tokens=False)[0].ids, dtype=np.int32) for t in texts for s in t]
            it = iter(found)
            for t in texts:
                ids.append(np.concatenate([next(it) for _ in t]))
                counts.append(len(ids[-1]))
            columns = [batch.column("doc_id"), _lists(np.concatenate(ids), counts)]
            if offsets:
                table = byte_table(shared)
                spans = [character_spans(x, table) for x in ids]
                columns += [_lists(np.concatenate(side), counts) for side in zip(*spans)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts", "ends"][:len(columns)])
    return run


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, offsets: bool = True) -> DataFrame:
    """(doc_id, ids, starts, ends) for every row of docs(doc_id, text); without the last two if ``offsets`` is False.

    The vocabulary is broadcast, a fixed table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())
    schema = "doc_id bigint, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded(shared, offsets), schema)


def completed(raw: bytes, ends: list[int]) -> list[str]:
    """The text that each token completes; bytes left over at the end belong to the last token."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    cuts = list(zip([0, *ends], ends))
    return [decoder.decode(raw[a:b], final=k == len(cuts)) for k, (a, b) in enumerate(cuts, 1)]


def _decoded(shared, parts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(shared)
        for batch in batches:
            n = pa.compute.list_value_length(batch.column("ids")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(n) // TOKENS
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                some, counts = batch.column("ids").slice(a, b - a), n[a:b]
                ids = some.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                raw, token_ends = bytes_of(ids, table)
                cuts = np.concatenate(([0], token_ends))[np.concatenate(([0], np.cumsum(counts)))]
                data = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
                columns = [batch.column("doc_id").slice(a, b - a), data]
                if parts:
                    upto, whole = np.concatenate(([0], np.cumsum(counts))), data.to_pylist()
                    columns.append(pa.array([completed(whole[i], (token_ends[upto[i]:upto[i + 1]] - cuts[i]).tolist()) for i in range(len(counts))],
                                            pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "data", "parts"][:len(columns)])
    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None, parts: bool = True) -> DataFrame:
    """(doc_id, data, parts): for every row of encoded(doc_id, ids) its bytes, and the text that each token completes if ``parts``."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())
    schema = "doc_id bigint, data binary" + (", parts array<string>" if parts else "")
    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<bigint>").alias("ids")).mapInArrow(_decoded(shared, parts), schema)


def digests(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs(doc_id, text).

    Rows have no key that could join the two directions again, so a batch is
    encoded, and decoded from its ids alone, in one pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())
    there, back = _encoded(shared, False), _decoded(shared, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in there(batches):
            decoded = pa.Table.from_batches(list(back([batch]))).combine_chunks()
            data = decoded.column("data").combine_chunks() if batch.num_rows else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, data], ["doc_id", "ids", "data"])
    both = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<int>, data binary")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("data", 256).alias("decoded_sha256"))


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and round trip of every document."""
    return digests(read(spark, sf_dir, "documents"))
