import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from threatloom.llm import byte_bpe as B

VOCABULARY = B.load_vocabulary()


class Shared:
    def __init__(self, value):
        self.value = value


SHARED = Shared(VOCABULARY)
TABLE = B.byte_table(SHARED)


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(13)
    yield from ("", " ", "\n\n  x", "don't we'll 's 'S", "<|endoftext|>", "日本語 😀😀 é", "a" * 5000, " " * 3000, "1234567890" * 50, "  x​", "x\r\n\ty ")
    alphabet = "abcdeſßéñ  \n\t'strelm019.,-_日本語😀 ́"
    for _ in range(400):
        yield "".join(random.choices(alphabet, k=random.randint(1, 200)))
    for _ in range(200):
        yield "".join(chr(random.choice([*range(0x20, 0x3000), *range(0xE000, 0x11000), *range(0x1F300, 0x1F700)])) for _ in range(30))


def test_ids_and_offsets_against_the_libraries(plain):
    tokenizer = B.tokenizer_of(SHARED)
    for text in texts():
        e = tokenizer.encode(text, add_special_tokens=False)
        assert e.ids == plain.encode_ordinary(text)
        start, end = B.character_spans(np.array(e.ids, dtype=np.int64), TABLE)
        assert list(zip(start.tolist(), end.tolist())) == e.offsets


def test_segments_do_not_change_ids(plain):
    random.seed(5)
    for text in texts():
        for limit in (1, 7, 50):
            cut = B.segments(text, limit)
            assert "".join(cut) == text
            assert [i for s in cut for i in plain.encode_ordinary(s)] == plain.encode_ordinary(text)


def test_query_against_tiktoken(spark, sf, plain):
    given = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = B.op13_byte_bpe(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(given)
    for r in rows:
        text = given[r["doc_id"]]
        ids = plain.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_with_offsets_and_parts(spark, plain):
    some = list(texts())
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id int, text string")
    encoded = B.encode(docs)
    assert encoded.columns == ["doc_id", "ids", "starts", "ends"]
    for r in encoded.collect():
        text = some[r["doc_id"]]
        assert r["ids"] == plain.encode_ordinary(text) and len(r["starts"]) == len(r["ends"]) == len(r["ids"])
    for r in B.decode(encoded).collect():
        text = some[r["doc_id"]]
        assert bytes(r["data"]).decode() == text == "".join(r["parts"])


def test_split_characters_and_unknown_ids(spark, plain):
    face = plain.encode_ordinary("😀")
    assert len(face) > 1
    rows = [(1, face), (2, face[:-1]), (3, [face[0], -5, 60_000, None, 64]), (4, []), (5, None)]
    got = {r["doc_id"]: r for r in B.decode(spark.createDataFrame(rows, "doc_id int, ids array<int>")).collect()}
    assert got[1]["parts"] == [""] * (len(face) - 1) + ["😀"]
    assert bytes(got[2]["data"]) == plain.decode_bytes(face[:-1]) and got[2]["parts"][-1] == "�"
    assert bytes(got[3]["data"]) == plain.decode_bytes(face[:1]) + b"\xef\xbf\xbd" * 3 + plain.decode_bytes([64])
    assert bytes(got[4]["data"]) == bytes(got[5]["data"]) == b"" and got[5]["parts"] == []


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "the the", 0), (3, "word " * 200_000, 0), (3, "word " * 200_000, 0), (4, "y" * 300_000, 0)],
                                 "doc_id int, text string, ids int")
    rows = sorted(((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in B.digests(docs).collect()))
    nothing = hashlib.sha256(b"").hexdigest()
    assert rows[1] == (1, 0, nothing, nothing) and rows[2] == (2, 0, nothing, nothing)
    assert rows[3] == rows[4] and rows[3][3] == hashlib.sha256(b"word " * 200_000).hexdigest() and rows[3][1] == 200_001
    assert rows[0][1] == 2 and rows[5][3] == hashlib.sha256(b"y" * 300_000).hexdigest()
    assert B.digests(docs.limit(0)).count() == 0 and B.encode(docs.limit(0)).count() == 0 and B.decode(B.encode(docs).limit(0)).count() == 0


def test_a_broken_file_is_refused(tmp_path):
    bad = tmp_path / "ranks"
    bad.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)) + base64.b64encode(b"abc") + b" 256\n")
    with pytest.raises(ValueError):
        B.load_vocabulary(str(bad), "x")
