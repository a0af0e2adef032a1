"""Toxicity by compression distance between two zstandard dictionaries.

Both dictionaries hold windows of ordinary text, taken by hash over whole texts.
The toxic one also holds the segments of labelled toxic text that cover its
telling d-mers: runs of ``D`` bytes, marks of word beginnings included, that many
toxic words have and that are ``TIMES`` times rarer among ordinary ones, as in
dictionary training by coverage. A text is cut into windows of one word. A window
is compressed whole under both dictionaries, between stretches of ordinary text
(the compressor finds no match in the last bytes of a block, and stores very
short ones raw); its gain is what the toxic dictionary saves, summed over
``CONTEXTS`` pairs of stretches, those that tell the two kinds of training words
apart best. Ordinary words that gain go into both dictionaries.

For each of ``LEVELS`` a text has a rate: how many of its windows gain as much,
against how many would among as many windows of ordinary text, both with a prior
count. Rates, not counts or lengths, go through a calibrated logistic curve.

Fitting uses a bounded sample of labelled rows: about ``SAMPLE`` texts of each
class by hash, read whole. Three quarters build the dictionaries; the rest, which
they never saw, sets the expected shares and the curve; the intercept is moved
from the sample's shares to those of all labels. Only rows outside the held-out
fold are used. Scoring covers every window of every text in one pass without
shuffle; gains are remembered for ``MEMO`` words at a time.

Defined results: null text scores as empty text; empty texts have the score of
a text without windows; without usable labels of both classes every score is the
share of toxic labels (0 without any); a null id is not held out; of several
labels of a row the largest counts; repeated rows repeat their result; an empty
table gives no rows; other columns are ignored.
"""

from collections import Counter
from itertools import cycle, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .common import byte_texts, pieces, read
from .words import FOLD, mixed

SAMPLE, BODY, MEMO = 3000, 300 << 10, 300_000
#: A d-mer is telling when so large a share of toxic texts would have it in one word each, and so many times as often as ordinary ones.
D, SHARE, TIMES = 8, 0.02, 8
PIECE, THRESHOLD = 48, 0.3
#: Gains of which rates are taken, and the prior count of a rate.
LEVELS, PRIOR = (1, 2, 3, 4, 5, 6, 8, 10, 13), 0.5
#: Pairs of stretches that are tried, and used; bytes of a stretch; gain of an ordinary word that goes into both dictionaries; how often that is done.
TRIED, CONTEXTS, STRETCH, NEAR, ROUNDS = 32, 2, 24, 3, 2
#: Stands before every word, in dictionaries and windows: a match that starts with a word is worth more than one inside it.
MARK = b"\x01\x02\x03"


def windows(text: bytes) -> list[bytes]:
    """Words of a text (A-Z lower-cased), long ones in pieces that end between characters."""
    words = text.translate(FOLD).split()
    if len(text) > PIECE and max(map(len, words), default=0) > PIECE:
        return [p for w in words for p in parts(w)]
    return words


def parts(word: bytes) -> list[bytes]:
    out = []
    while len(word) > PIECE:
        cut = next((k for k in range(PIECE, PIECE - 4, -1) if word[k] & 0xC0 != 0x80), PIECE)
        out.append(word[:cut])
        word = word[cut:]
    return [*out, word]


def words_of_texts(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and how many texts have each."""
    counts = Counter()
    for t in texts:
        counts.update(dict.fromkeys(windows(t)).keys())  # in an order that reruns repeat
    return list(counts), np.array(list(counts.values()), dtype=np.int64)


def d_mers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All D-byte runs of the words between their marks, as numbers, and the word that each comes from."""
    n = np.array([len(w) for w in words], dtype=np.int64) + 2 * len(MARK)
    raw = np.frombuffer(b"".join([MARK + w + MARK for w in words]) + bytes(D), dtype=np.uint8)
    value = np.zeros(len(raw) - D, np.uint64)
    for k in range(D):
        value |= raw[k:len(raw) - D + k].astype(np.uint64) << np.uint64(8 * k)
    owner = np.repeat(np.arange(len(words)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + D <= n[owner]
    return value[inside], owner[inside]


def telling_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words of toxic texts that hold a telling d-mer, the most frequent last."""
    words, n = words_of_texts(toxic)
    if not words:
        return []
    value, owner = d_mers(words)
    values, at = np.unique(value, return_inverse=True)
    have, others = np.bincount(at, n[owner]), np.zeros(len(values))
    plain, m = words_of_texts(ordinary)
    for a in range(0, len(plain), 1 << 17):  # so many words at a time
        value, own = d_mers(plain[a:a + (1 << 17)])
        place = np.minimum(np.searchsorted(values, value), len(values) - 1)
        hit = values[place] == value
        others += np.bincount(place[hit], m[a + own[hit]], minlength=len(values))
    good = (have >= max(3, SHARE * len(toxic))) & (have >= TIMES * (others * len(toxic) / len(ordinary) + 0.5))
    some = np.unique(owner[good[at]])
    return [words[i] for i in some[np.argsort(n[some], kind="stable")]]


def sampled_windows(texts: list[bytes], limit: int) -> list[bytes]:
    """Distinct windows of about ``limit`` bytes by hash over all occurrences, wherever in a text they stand; those met first come last."""
    first = {}
    for i, t in enumerate(texts):
        words = windows(t)
        for w, h in zip(words, mixed(np.arange(len(words), dtype=np.uint64) + np.uint64(i << 32)).tolist()):
            if h < first.get(w, 1 << 64):
                first[w] = h
    order = sorted(first, key=first.get)
    upto = np.searchsorted(np.cumsum([len(MARK) + len(w) for w in order]), limit, "right")
    return order[:upto][::-1]


def joined(words) -> bytes:
    return b"".join(MARK + w for w in words)


class Model:
    """Dictionaries, stretches and curve; plain bytes and numbers, so that it travels to tasks."""

    def __init__(self, body: list[bytes], vocabulary: list[bytes]):
        self.body, self.vocabulary = body, vocabulary
        self.mean = self.scale = self.weights = self.expected = None
        self.contexts = self.stretches(1)
        self._open()

    def stretches(self, n: int) -> list[tuple[bytes, bytes]]:
        """Pairs of stretches of the body from ``n`` places."""
        def at(k):
            out = b""
            for w in islice(cycle(self.body), k, k + STRETCH):
                out += MARK + w
                if len(out) >= STRETCH:
                    break
            return out
        size = len(self.body)
        return [(at(size * k // (n + 1)), at((size * k // (n + 1) + size // 2) % size)) for k in range(1, n + 1)] if size else [(b"", b"")]

    def _open(self):
        end = joined(self.body[len(self.body) // 3:][:8])  # the last bytes of a dictionary are not searched
        self.ordinary, self.toxic, self.memo = self._compressor(joined(self.body) + end), self._compressor(joined(self.body) + joined(self.vocabulary) + end), {}

    @staticmethod
    def _compressor(content: bytes):
        how = zstandard.ZstdCompressionParameters(
            window_log=20, chain_log=18, hash_log=17, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        return zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(
            content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("ordinary", "toxic", "memo")}

    def __setstate__(self, state):
        vars(self).update(state)
        self._open()

    def gain(self, word: bytes) -> int:
        g = self.memo.get(word)
        if g is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            g = 0
            for before, after in self.contexts:
                window = before + MARK + word + after
                g += len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
            g = self.memo[word] = max(0, min(LEVELS[-1], g))
        return g

    def settle(self, ordinary: list[bytes]) -> None:
        """Take the stretches between which vocabulary gains often and ordinary words seldom."""
        words, n = words_of_texts(ordinary)
        if not words or not self.vocabulary:
            return
        order = np.argsort(-n, kind="stable")
        often, seldom = order[:400], order[400:][::max(1, (len(order) - 400) // 400)]
        share = np.concatenate((n[often], np.full(len(seldom), (n.sum() - n[often].sum()) / max(1, len(seldom)))))
        plain, telling = [words[i] for i in (*often, *seldom)], self.vocabulary[::max(1, len(self.vocabulary) // 300)]
        found = []
        for context in self.stretches(TRIED):
            self.contexts, self.memo = [context], {}
            reach = lambda some, w: np.bincount([self.gain(x) for x in some], w, LEVELS[-1] + 1)[::-1].cumsum()[::-1][1:] / w.sum()
            a, b = reach(telling, np.ones(len(telling))), reach(plain, share)
            found.append((max(a * np.log((a + 1e-3) / (b + 1e-4))), context))
        found.sort(key=lambda x: -x[0])
        self.contexts, self.memo = [c for _, c in found[:CONTEXTS]], {}

    def reached(self, text: bytes) -> np.ndarray:
        """Number of windows, and of those that gain at least each of LEVELS."""
        counts = np.bincount([self.gain(w) for w in windows(text)], minlength=LEVELS[-1] + 1)
        return counts[::-1].cumsum()[::-1][[0, *LEVELS]]

    def rates(self, reached: np.ndarray) -> np.ndarray:
        return np.log((reached[:, 1:] + PRIOR) / (reached[:, :1] * self.expected + PRIOR))

    def calibrate(self, toxic: list[bytes], ordinary: list[bytes], prior: float) -> None:
        """Expected shares from ordinary texts; logistic regression with a small ridge, by Newton steps; then the wanted prior."""
        bad, plain = (np.array([self.reached(t) for t in texts]) for texts in (toxic, ordinary))
        total = plain.sum(axis=0)
        self.expected = (total[1:] + 1) / (total[0] + 1)
        x, y = self.rates(np.concatenate((bad, plain))), np.r_[np.ones(len(bad)), np.zeros(len(plain))]
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (y - p) - w)
        w[-1] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
        self.weights = w

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = self.rates(np.array([self.reached(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights, -50, 50)))


def train(toxic: list[bytes], ordinary: list[bytes], prior: float) -> Model | None:
    """Model from two lists of texts; None when there are too few."""
    (tox_a, tox_b), (ord_a, ord_b) = (([x for i, x in enumerate(t) if i % 4], t[::4]) for t in (toxic, ordinary))
    if not (tox_a and ord_a):
        return None
    model = Model(sampled_windows(ord_a, BODY), telling_words(tox_a, ord_a))
    model.settle(ord_a)
    plain = sorted(set(words_of_texts(ord_a)[0]))
    # Ordinary words that share much with the toxic vocabulary belong to the ordinary text of both.
    for _ in range(ROUNDS):
        near = [w for w in plain if model.gain(w) >= NEAR]
        model = Model(model.body + near, model.vocabulary)
        model.settle(ord_a)
    model.calibrate(tox_b, ord_b, prior)
    model.memo.clear()
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model | None, float]:
    """Model and share of toxic labels, from labels(doc_id, toxic) outside the held-out fold."""
    known = (labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where("pmod(crc32(CAST(doc_id AS STRING)), 4) <> 2"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return None, prior
    parts = 1 << 30
    share = F.when(F.col("toxic") == 1, int(parts * min(1, sample / n[1]))).otherwise(int(parts * min(1, sample / n[0])))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(parts)) < share)  # about 2 x sample rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", F.col("text").cast("binary").alias("text"), "toxic").toPandas().sort_values("doc_id", kind="stable")
    of = lambda y: [bytes(t) for t in texts.loc[texts["toxic"] == y, "text"] if t is not None]
    return train(of(1), of(0), prior), prior


def scores(model: Model | None, prior: float, texts: list[bytes]) -> np.ndarray:
    return model.score(texts) if model else np.full(len(texts), prior)


def _scored(model: Model | None, prior: float):
    def run(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(model, prior, byte_texts(batch, "text")))], ["doc_id", "score"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = docs.mapInArrow(_scored(*fit(docs, labels, sample)), "doc_id bigint, score double")
    held = F.coalesce(F.expr("pmod(crc32(CAST(doc_id AS STRING)), 4) = 2"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of docs that are not predicted toxic, with all their columns."""
    model, prior = fit(docs, labels, sample)

    def keep(batches):
        for batch in pieces(batches):
            yield batch.filter(pa.array(scores(model, prior, byte_texts(batch, "text")) < THRESHOLD))
    return docs.mapInArrow(keep, docs.schema)


@query("op1_score_toxicity")
def op1_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))
