"""Merkle manifest of a data set, with proofs by octopus multiproofs.

Every row is a leaf: the hash of its fields, each ``-`` if null, else its number
of UTF-8 bytes, ``:`` and its value. The leaves of one group, in the order of
their ids, are the lowest level of a tree; every ``ARITY`` consecutive nodes of a
level are one node of the next, until one is left. The groups' roots, in the
order of the groups, are the leaves of one more tree, whose top is the root.

A manifest has two stored tables: the leaves with their places, and the nodes of
all levels. Places come from one range sort of narrow rows; a leaf's place is its
row number in the sorted table less that of its group's first row. Nodes are
built ``height`` levels at a time, each run of ``ARITY ** height`` nodes in one
task of bounded size.

Proofs are made for a whole leaf partition at once (a run of ``ARITY ** height``
places, whichever of them are asked for). The partition computes the smallest set
of nodes that its paths need and that it can't derive from its own leaves; these
sets are joined to the nodes once; interior nodes that several paths share are
hashed once, and every leaf's proof is cut out of them. A proof has one entry a
level: the siblings to the left and to the right, their digests end to end.

Defined results: null fields are ``-``; the null group comes first; null ids come
first within a group, and rows of one id are ordered by their leaf; equal rows are
leaves of their own in neighbouring places; an empty table has no leaves, nodes or
proofs; texts of any length are hashed whole; other columns are ignored unless
they are named in ``carry``, and must not be called tree, pos, leaf or label there.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalogue import query
from .common import BROADCAST_ROWS, attach, checkpointed, read
from .embedding_dedup import few_rows_a_batch

ARITY, HEIGHT = 8, 4
#: Name of the tree over the groups' roots; groups have numbers from 0.
TOP = -1
#: Leaves whose proofs leave a task in one batch.
SLICE = 512


@dataclass
class Manifest:
    """leaves(tree, pos, leaf, label, key columns, carried columns), nodes(tree, level, idx, digest) and trees(tree, label, n, subroot)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    groups: int
    root: str | None
    height: int


def field(c: Column) -> Column:
    """One field as it is hashed."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode("ascii")).hexdigest()


def parents(n: int) -> int:
    return -(-n // ARITY)


def numbered(rows: DataFrame, label: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``pos``, their place among those of the same label; and (label, n). The label is never null.

    One range sort, stored; what is joined back is one row a partition and label.
    """
    sorted_rows = rows.repartitionByRange(label, *order).sortWithinPartitions(label, *order)
    placed = checkpointed(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    keyed = placed.withColumn("_run", F.concat(F.shiftright("_at", 33).cast("string"), F.lit(" "), F.col(label)))
    runs = checkpointed(keyed.groupBy("_run", label).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")))
    # A label's window has one row for each partition that holds some of it.
    before = F.sum("_n").over(W.partitionBy(label).orderBy("_first").rowsBetween(W.unboundedPreceding, -1))
    starts = runs.select("_run", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    out = attach(keyed, starts, "_run", ["_at"], runs.count()).withColumn("pos", F.col("_at") + F.col("_shift"))
    return out.drop("_at", "_run", "_shift"), runs.groupBy(label).agg(F.sum("_n").alias("n"))


def _climb(height: int):
    """Interior nodes above one run: up to ``height`` levels, or to the only node of the tree."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, number = (k.as_py() for k in key)
        level, n = table.column("level")[0].as_py(), table.column("n")[0].as_py()
        now, first = table.column("digest").to_pylist(), number * ARITY ** height
        levels, places, digests = [], [], []
        for _ in range(height):
            if n == 1:
                break
            now = [digest("".join(now[i:i + ARITY])) for i in range(0, len(now), ARITY)]
            n, first, level = parents(n), first // ARITY, level + 1
            levels += [level] * len(now)
            places += range(first, first + len(now))
            digests += now
        return pa.table({"tree": pa.array([tree] * len(digests), pa.int64()), "level": pa.array(levels, pa.int32()),
                         "idx": pa.array(places, pa.int64()), "digest": pa.array(digests, pa.string())})
    return run


def tree_nodes(lowest: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """All nodes of the trees over lowest(tree, idx, digest, n), n nodes in the tree; and (tree, subroot)."""
    every = live = checkpointed(lowest.select("tree", F.lit(0).alias("level"), "idx", "digest", "n"))
    tops = live.where("n = 1").select("tree", F.col("digest").alias("subroot"))
    live = live.where("n > 1")
    every = every.select("tree", "level", "idx", "digest")
    while not live.isEmpty():
        schema = "tree bigint, level int, idx bigint, digest string"
        grown = live.withColumn("_run", F.floor(F.col("idx") / ARITY ** height)).groupBy("tree", "_run").applyInArrow(_climb(height), schema)
        sizes = live.select("tree", "n", F.col("level").alias("_from")).distinct()
        # One row a tree.
        grown = checkpointed(grown.join(sizes, "tree"))
        up = F.expr(f"aggregate(sequence(1, level - _from), n, (m, k) -> (m + {ARITY - 1}) div {ARITY})")
        counted = grown.select("tree", "level", "idx", "digest", "_from", up.alias("n"))
        every = every.unionByName(grown.select("tree", "level", "idx", "digest"))
        tops = tops.unionByName(counted.where("n = 1").select("tree", F.col("digest").alias("subroot")))
        live = checkpointed(counted.where(f"n > 1 AND level = _from + {height}").drop("_from"))
    return every, checkpointed(tops)


def build(rows: DataFrame, fields: list[str], group: str, ident: str, carry: tuple = (), height: int = HEIGHT) -> Manifest:
    """Manifest of rows: leaves from ``fields`` in that order, one tree for each value of ``group``, ordered by ``ident``."""
    named = rows.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("label"), F.col(ident).alias("ident"),
                        leaf_hash([F.col(f) for f in fields]).alias("leaf"), *carry)
    placed, sizes = numbered(named, "label", ["ident", "leaf", *carry])
    order, _ = numbered(sizes.withColumn("all", F.lit("")), "all", ["label"])
    order = checkpointed(order.select("label", F.col("pos").alias("tree"), "n"))
    groups = order.count()
    leaves = checkpointed(attach(placed, order, "label", ["pos"], groups))
    nodes, tops = tree_nodes(leaves.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("digest"), "n"), height)
    trees = checkpointed(order.join(tops, "tree"))
    above, top = tree_nodes(trees.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"),
                                         F.lit(groups).cast("bigint").alias("n")), height)
    root = top.head()
    return Manifest(leaves, checkpointed(nodes.unionByName(above)), trees, groups, root["subroot"] if root else None, height)


def levels_of(n: int) -> list[int]:
    """Nodes of each level of a tree over n leaves, from the lowest to the top."""
    out = [n]
    while out[-1] > 1:
        out.append(parents(out[-1]))
    return out


def missing_nodes(places: np.ndarray, n: int) -> list[np.ndarray]:
    """For each level below the top the nodes that the paths of ``places`` need and that can't be derived from them."""
    out = []
    for size in levels_of(n)[:-1]:
        up = np.unique(places // ARITY)
        needed = (up[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append(np.setdiff1d(needed[needed < size], places))
        places = up
    return out


def paths(places: list[int], digests: list[str], n: int, fetched: dict) -> tuple[dict[int, tuple[list, list]], str]:
    """Siblings to the left and right on the way up from each place, and the top; every interior node is hashed once."""
    known, sides = dict(zip(places, digests)), []
    for level, size in enumerate(levels_of(n)[:-1]):
        asked = sorted(known)
        known.update(fetched.get(level, {}))
        above, side = {}, {}
        for i in asked:
            run = i // ARITY
            if run not in above:
                first = run * ARITY
                joined = "".join([known[k] for k in range(first, min(first + ARITY, size))])
                above[run] = (digest(joined), joined)
            joined, at = above[run][1], (i % ARITY) * 64
            side[i] = (joined[:at], joined[at + 64:])
        sides.append(side)
        known = {run: d for run, (d, _) in above.items()}
    upper = {0: ([], [])}
    for side in reversed(sides):
        upper = {i: ([left, *upper[i // ARITY][0]], [right, *upper[i // ARITY][1]]) for i, (left, right) in side.items()}
    return upper, next(iter(known.values()))


def _wanted(groups: int):
    """Coordinates (part, tree, level, idx) of the nodes that a leaf partition has to fetch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                part, tree, n = (batch.column(c)[i].as_py() for c in ("part", "tree", "n"))
                places = np.unique(batch.column("pos")[i].values.to_numpy())
                for t, need in ((tree, missing_nodes(places, n)), (TOP, missing_nodes(np.array([tree]), groups))):
                    for level, idx in enumerate(need):
                        for column, values in zip(out, ([part] * len(idx), [t] * len(idx), [level] * len(idx), idx.tolist())):
                            column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64()))],
                                             ["part", "tree", "level", "idx"])
    return run


def _expanded(groups: int, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, n, label = (batch.column(c)[i].as_py() for c in ("tree", "n", "label"))
                fetched: dict = {tree: {}, TOP: {}}
                for node in batch.column("fetched")[i].as_py() or []:
                    fetched[node["tree"]].setdefault(node["level"], {})[node["idx"]] = node["digest"]
                rows = batch.column("rows")[i].values
                places, leaves = rows.field("pos").to_pylist(), rows.field("leaf").to_pylist()
                own, subroot = paths(places, leaves, n, fetched[tree])
                over, root = paths([tree], [subroot], groups, fetched[TOP])
                above = over[tree]
                for a in range(0, len(places), SLICE):
                    some = places[a:a + SLICE]
                    left, right, ends = [], [], [0]
                    for p in some:
                        left += own[p][0] + above[0]
                        right += own[p][1] + above[1]
                        ends.append(len(left))
                    entries = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
                    kept = rows.slice(a, len(some))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(some), pa.string()), *(kept.field(c) for c in ("pos", "ident", "leaf", *carried)),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries), pa.array([subroot] * len(some)), pa.array([root] * len(some))],
                        ["label", "pos", "ident", "leaf", *carried, "proof", "subroot", "root"])
    return run


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """(label, pos, ident, leaf, carried columns, proof, subroot, root) of wanted leaves, rows of the manifest's leaves; all by default."""
    leaves = manifest.leaves if wanted is None else wanted
    spark = leaves.sparkSession
    carried = [c for c in leaves.columns if c not in ("tree", "pos", "leaf", "label", "ident", "n")]
    rows = F.struct("pos", "ident", "leaf", *carried)
    packed = leaves.withColumn("part", F.concat_ws(" ", "tree", F.floor(F.col("pos") / ARITY ** manifest.height))).groupBy("part", "tree", "label", "n").agg(
        F.array_sort(F.collect_list(rows)).alias("rows"))
    parts = checkpointed(packed)
    with few_rows_a_batch(spark, 4):
        need = checkpointed(parts.select("part", "tree", "n", F.col("rows.pos").alias("pos")).mapInArrow(
            _wanted(manifest.groups), "part string, tree bigint, level int, idx bigint"))
        few = need.count() <= BROADCAST_ROWS
        found = manifest.nodes.join(F.broadcast(need) if few else need, ["tree", "level", "idx"])
        # At most ARITY - 1 nodes a level and path end for a whole partition.
        fetched = checkpointed(found.groupBy("part").agg(F.collect_list(F.struct("tree", "level", "idx", "digest")).alias("fetched")))
        types = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
        schema = ", ".join(["label string", *(f"{c} {types[c]}" for c in ("pos", "ident", "leaf", *carried)),
                            "proof array<struct<left: string, right: string>>", "subroot string", "root string"])
        return parts.join(fetched, "part", "left").mapInArrow(_expanded(manifest.groups, carried), schema)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda below, entry: F.sha2(F.concat(entry["left"], below, entry["right"]), 256))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Digest columns of op12: all proofs of a manifest of docs, folded from the leaves of partly tampered rows."""
    ident = F.col("doc_id").cast("bigint")
    hit = F.coalesce(F.crc32(ident.cast("string")) % 3 == 0, F.lit(False))
    changed = F.when(hit, leaf_hash([F.col(f) if f != "text" else lowered(F.col(f)) for f in FIELDS]))
    rows = docs.select(*FIELDS).withColumn("doc_id", ident).withColumn("found", changed)
    proofs = prove(build(rows, FIELDS, "lang", "doc_id", ("found",), height))
    siblings = F.array_join(F.transform("proof", lambda e: F.concat(e["left"], e["right"])), "")
    out = proofs.select(F.col("ident").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                        folded(F.coalesce("found", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int) -> str:
    """SQL over trees of at most ``levels`` levels."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if f == "text" else f) for f in FIELDS) + ")"
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))")
    steps = [f"l AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS found FROM documents)",
             "p0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS i0 FROM l)",
             "a0 AS MATERIALIZED (SELECT lang AS t, i0 AS i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM p0)"]

    def climb(a: str) -> None:
        for k in range(levels):
            steps.append(
                f"{a}{k + 1} AS MATERIALIZED (SELECT t, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, "
                f"(any_value(n) + 7) // 8 AS n, any_value(n) > 1 AS up, CASE WHEN any_value(n) > 1 THEN list(d ORDER BY i) END AS run FROM {a}{k} GROUP BY t, i // 8)")
    climb("a")
    steps.append("b0 AS MATERIALIZED (SELECT 0 AS t, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS i, d, count(*) OVER () AS n, t AS lang "
                 f"FROM a{levels} WHERE i = 0)")
    climb("b")
    steps.append("f0 AS MATERIALIZED (SELECT p0.doc_id, p0.lang AS t, p0.i0 AS i, p0.leaf, b0.i AS j, b0.d AS subroot, '' AS proof, p0.found AS s "
                 "FROM p0 JOIN b0 ON b0.lang IS NOT DISTINCT FROM p0.lang)")
    made = 0
    for a, at in (("a", "i"), ("b", "j")):
        for k in range(1, levels + 1):
            place, same = f"((f.{at} // {8 ** (k - 1)}) % 8)", "x.t IS NOT DISTINCT FROM f.t" if a == "a" else "true"
            steps.append(
                f"f{made + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (proof, s, up, l, r), CASE WHEN up THEN proof || l || r ELSE proof END AS proof, "
                f"CASE WHEN up THEN sha256(l || s || r) ELSE s END AS s FROM (SELECT f.*, x.up, array_to_string(x.run[:{place}], '') AS l, "
                f"array_to_string(x.run[{place} + 2:], '') AS r FROM f{made} f JOIN {a}{k} x ON x.i = f.{at} // {8 ** k} AND {same}) f)")
            made += 1
    return (f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, s AS folded_root, s = d AS verified "
            f"FROM f{made} CROSS JOIN (SELECT d FROM b{levels}) AS top")


@query("op12_merkle_manifest", _sql(8))
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof digest and outcome of the audit of every document."""
    return audit(read(spark, sf_dir, "documents"))
