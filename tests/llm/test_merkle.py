import hashlib
import zlib

import numpy as np
import pytest

from threatloom.llm import merkle as M


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    fields = [row[f] for f in M.FIELDS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def climb(tree, i):
    """Siblings left and right, level by level."""
    for level in tree[:-1]:
        run = level[i - i % 8:i - i % 8 + 8]
        yield run[:i % 8], run[i % 8 + 1:]
        i //= 8


def plain(rows):
    """The whole audit, one row after another."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for number, g in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*climb(trees[g], i), *climb(top, number)]
            at, text = leaf, r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                at = leaf_of({**r, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in text)})
            for left, right in path:
                at = sha("".join(left) + at + "".join(right))
            proof = sha("".join("".join(left) + "".join(right) for left, right in path))
            out.append((r["doc_id"], leaf, trees[g][-1][0], top[-1][0], proof, at, at == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("height", [2, 4])
def test_audit_against_brute_force(spark, sf, height):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    made = got(M.audit(docs, height))
    assert made == plain(rows)
    assert {v for *_, v in made} == {True, False}


def test_edges(spark):
    rows = [(1, "a", None, 3, "Abc"), (None, "a", None, 3, "Abc"), (None, None, None, None, None), (3, "b", "de", 0, ""), (3, "b", "de", 0, ""),
            (3, "b", "de", 1, ""), (6, "ü", "é", 1, "X" * 200_000), (7, "b", "", None, None), (9, "b", "zz", 1, "ÄÖ Big")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id int, source string, lang string, n_chars int, text string, leaf string, tree int")
    assert got(M.audit(docs)) == plain([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])
    assert got(M.audit(docs.where("doc_id = 9"))) == plain([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), rows[-1]))])
    assert got(M.audit(docs.limit(0))) == []


def test_wide_group_and_many_groups(spark):
    rows = [(i, "s", "en" if i % 3 else f"l{i}", i, f"Text {i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string")
    assert got(M.audit(docs)) == plain([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])


def test_a_partition_fetches_the_smallest_union():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 64, 65, 700, 4097):
        tree = levels([sha(str(i)) for i in range(n)])
        for _ in range(10):
            places = np.unique(rng.integers(0, n, rng.integers(1, 20)))
            need = M.missing_nodes(places, n)
            # What a path needs on a level and no asked leaf lies under.
            for level, idx in enumerate(need):
                on = {int(p) // 8 ** level for p in places}
                wanted = {k for p in on for k in range(p - p % 8, min(p - p % 8 + 8, len(tree[level])))}
                assert set(idx.tolist()) == wanted - on
            fetched = {level: {int(i): tree[level][i] for i in idx} for level, idx in enumerate(need)}
            own, top = M.paths(places.tolist(), [tree[0][p] for p in places], n, fetched)
            assert top == tree[-1][0]
            for p in places.tolist():
                assert list(zip(*own[p])) == [("".join(a), "".join(b)) for a, b in climb(tree, p)]


def test_proofs_of_a_subset(spark):
    docs = spark.createDataFrame([(i, "s", "en" if i % 4 else "de", i, f"Text {i}") for i in range(300)],
                                 "doc_id bigint, source string, lang string, n_chars int, text string")
    manifest = M.build(docs, M.FIELDS, "lang", "doc_id", height=2)
    every = {r["ident"]: r for r in M.prove(manifest).collect()}
    some = M.prove(manifest, manifest.leaves.where("ident % 37 = 5")).collect()
    assert len(some) == 8 and all(every[r["ident"]] == r for r in some)
    assert all(r["root"] == manifest.root for r in some)
