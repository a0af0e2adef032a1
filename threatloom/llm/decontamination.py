"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment.

Items are partitioned by their number of distinct five-word shingles. A
partition's signature keeps, of each item, its k smallest shingle hashes, with k
one more than a contained item may miss at the partition's upper size. So a
document that contains enough of an item has at least one of its minima, however
long the document is, and membership of minima is a search without misses.
Candidates are then verified by exact containment of the item's shingles.

All documents run against a stated query set, in blocks of at most
``BLOCK_ROWS`` shingles: a block of items is broadcast, documents are never
shuffled, and a larger benchmark means more blocks, not a larger broadcast.
Documents are read once a block.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased,
so case and punctuation do not hide a passage.

Defined results: items with fewer than five words, empty or null ones match
nothing; null texts contain nothing; repeated items or documents each give their
rows; empty tables give no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .common import byte_texts, checkpointed, pieces, read
from .words import FOLD, shingles

SHINGLE, CONTAINMENT, BLOCK_ROWS = 5, 0.75, 1_000_000
#: Upper sizes of the partitions grow by this factor.
GROWTH = 1.25


def _item_shingles(size):
    def run(batches):
        for batch in pieces(batches):
            hashes, counts = shingles(byte_texts(batch, "text"), FOLD, size, short=False)
            cuts = np.cumsum(counts)[:-1]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([h.view(np.int64).tolist() for h in np.split(hashes, cuts)], pa.list_(pa.int64()))],
                                             ["item_id", "hashes"])
    return run


class Block:
    """Signatures and shingles of a block of items, as flat sorted arrays."""

    def __init__(self, rows: list, containment: float):
        rows = [r for r in rows if len(r["hashes"])]
        self.ids = [r["item_id"] for r in rows]
        sets = [np.sort(np.array(r["hashes"], dtype=np.int64).view(np.uint64)) for r in rows]
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.need = np.array([int(np.ceil(containment * n - 1e-9)) for n in self.sizes], dtype=np.int64)
        upper = np.ceil(GROWTH ** np.ceil(np.log(np.maximum(self.sizes, 1)) / np.log(GROWTH)) + 1e-9)
        minima = np.minimum(self.sizes, np.floor((1 - containment) * upper + 1e-9).astype(np.int64) + 1)
        self.shingles, self.items = self._flat(sets)
        self.minima, self.minima_items = self._flat([s[:k] for s, k in zip(sets, minima)])

    @staticmethod
    def _flat(sets):
        values = np.concatenate([np.zeros(0, np.uint64), *sets])
        items = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        return values[order], items[order]

    @staticmethod
    def hits(values, items, hashes, owner):
        """(owner, item) for every hash that is among values; one row an occurrence."""
        lo, hi = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
        n = hi - lo
        found = np.flatnonzero(n)
        n = n[found]
        at = np.repeat(lo[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(owner[found], n), items[at]

    def found(self, hashes, owner):
        """(owner, item, common shingles) of the pairs whose containment is reached."""
        docs, items = self.hits(self.minima, self.minima_items, hashes, owner)
        candidates = np.unique(docs * len(self.ids) + items)
        if not len(candidates):
            return candidates, candidates, candidates
        of_candidates = np.isin(owner, candidates // len(self.ids))
        docs, items = self.hits(self.shingles, self.items, hashes[of_candidates], owner[of_candidates])
        pairs, common = np.unique(docs * len(self.ids) + items, return_counts=True)
        keep = np.isin(pairs, candidates) & (common >= self.need[pairs % len(self.ids)])
        return pairs[keep] // len(self.ids), pairs[keep] % len(self.ids), common[keep]


def blocks(items: DataFrame, containment: float = CONTAINMENT, size: int = SHINGLE, rows: int = BLOCK_ROWS):
    """Blocks of at most about ``rows`` shingles; the items of one block at a time are on the driver."""
    sets = checkpointed(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(
        _item_shingles(size), "item_id bigint, hashes array<bigint>"))
    n = -(-(sets.agg(F.sum(F.size("hashes"))).first()[0] or 0) // rows)
    part = F.pmod(F.xxhash64("hashes"), F.lit(max(1, n)))
    for k in range(n):
        yield Block(sets.where(part == k).collect(), containment)


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for every document that holds that share of an item's shingles."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, n_shingles bigint, n_found bigint"
    out = spark.createDataFrame([], schema)
    for block in blocks(items, containment, size):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            b = shared.value
            for batch in pieces(batches):
                hashes, counts = shingles(byte_texts(batch, "text"), FOLD, size, short=False)
                doc, item, common = b.found(hashes, np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc.astype(np.int64))), pa.array([b.ids[i] for i in item], pa.int64()), pa.array(b.sizes[item]), pa.array(common.astype(np.int64))],
                    ["doc_id", "item_id", "n_shingles", "n_found"])
        out = out.unionByName(docs.mapInArrow(run, schema))
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def without_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = SHINGLE) -> DataFrame:
    """Rows of docs that contain no item, with all their columns."""
    spark = docs.sparkSession
    for block in blocks(items, containment, size):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in pieces(batches):
                hashes, counts = shingles(byte_texts(batch, "text"), FOLD, size, short=False)
                hit = shared.value.found(hashes, np.repeat(np.arange(len(counts)), counts))[0]
                yield batch.filter(pa.array(~np.isin(np.arange(len(counts)), hit)))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM c JOIN n USING (item_id) WHERE n_found >= 0.75 * n_shingles
"""


@query("op8_decontaminate", SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    return contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
