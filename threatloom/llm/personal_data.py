"""Personal data by candidate spans and gradient-boosted trees.

Two kinds of spans. The base kinds (email, ip, card, phone) follow fixed
patterns with a check and are always kept. Beside them, high-recall generators
propose overlapping candidates: loose addresses, number groups, tokens of
letters and digits, values after words like "password". Boosted trees judge a
candidate by its format and context; those above a calibrated threshold become
redactions too, best first, as long as they do not overlap.

The trees are fitted on the candidates of all documents but a held-out quarter
(by hash of the id). A candidate counts as personal when
it covers a base span or what follows a credential word; as ordinary otherwise.
Whether a span passes its check is no feature, so the trees learn what such
data look like. The threshold is the lowest with the wanted precision over all
candidates of that quarter, which the trees did not see; its running counts by score
are taken bucket by bucket. Scoring covers every candidate of every whole text.

Every scan is linear in the text: patterns have possessive runs or are anchored
at a rare character, so a very long word costs no more than a long text.

Defined results: null text is empty text; a document without spans has zero
counts, the hash of nothing and an empty list; repeated rows repeat their
result; an empty table gives no rows; other columns are ignored.
"""

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import running_total
from .catalogue import query
from .common import checkpointed, pieces, read

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "number", "token", "credential")
PRECISION = 0.97
#: Buckets of scores for the threshold.
BUCKETS = 1000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
HAS_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the run of local characters before it, down to the last match, and the labels after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each base kind, leftmost and without overlap within a kind."""
    found = [list(emails(text)) if "@" in text else [], [], [], []]
    if not HAS_DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(map(small_part, m[0].split("."))):
            found[1].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found[2].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found[3].append(m.span())
    return found


#: Generators: kind, what the text must hold, pattern; the span is the last group.
GENERATORS = (
    ("address", "@", re.compile(r"(?<![^\s<>()\[\]\",;:])([^\s<>()\[\]\",;:@]++(?: ?@ ?)[^\s<>()\[\]\",;:@]++)")),
    ("address", "spelled", re.compile(r"(?i)\b(\w++ (?:at|\(at\)) \w++ (?:dot|\(dot\)) \w++)")),
    ("address", "digit", re.compile(r"(?<![0-9.])([0-9]++(?:\.[0-9]++){2,})")),
    ("address", ":", re.compile(r"(?<![0-9A-Fa-f:])((?:[0-9A-Fa-f]{1,4}:){3,}+[0-9A-Fa-f]{1,4})")),
    ("number", "digit", re.compile(r"(?<![0-9])(\+?+[0-9](?:[ ().-]{0,2}+[0-9]){5,}+)")),
    ("token", "digit", re.compile(r"(?<![A-Za-z0-9_-])((?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{8,}+)")),
    ("credential", "credential", re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}+[=:]\s{0,3}+[\"']?([^\s\"']++)")),
)
CREDENTIAL_WORDS = ("passw", "pwd", "secret", "token", "api")

FEATURES = ("length", "digits", "letters", "upper", "other", "digit_share", "runs", "distinct_share", "entropy", "dots", "hyphens", "spaces",
            "at", "plus", "longest_digits", "longest_letters", "before_equal", "before_colon", "before_quote", "before_space",
            "after_space", "after_stop", "word_before", "digit_near", "line_start", "is_address", "is_number", "is_token", "is_credential")
RUNS = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format of a span and its context."""
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    upper = sum(c.isupper() for c in s)
    runs = RUNS.findall(s)
    counts = [s.count(c) for c in set(s)]
    before, after = text[max(0, a - 24):a], text[b:b + 12]
    stripped = before.rstrip(" ")
    word = re.search(r"([A-Za-z]+)\W*$", before)
    n = len(s)
    return [n, digits, letters, upper, n - digits - letters, digits / n, len(runs), len(counts) / n,
            -sum(c / n * math.log2(c / n) for c in counts), s.count("."), s.count("-"), s.count(" "), s.count("@"), s.count("+"),
            max((len(r) for r in runs if r[0].isdigit()), default=0), max((len(r) for r in runs if r[0].isalpha()), default=0),
            stripped.endswith("="), stripped.endswith(":"), before[-1:] in ('"', "'"), before[-1:] == " ",
            after[:1] == " ", after[:1] in (".", ",", ";"), len(word[1]) if word else 0,
            any(c.isdigit() for c in before + after), a == 0 or before[-1:] == "\n",
            kind == "address", kind == "number", kind == "token", kind == "credential"]


def candidates(text: str, base: list) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, label); label 1: covers a base span or what follows a credential word."""
    out = []
    low = text.lower()
    has = {"digit": HAS_DIGIT.search(text) is not None, "credential": any(w in low for w in CREDENTIAL_WORDS),
           "spelled": " at " in low or "(at)" in low}
    for kind, needs, pattern in GENERATORS:
        if not (has[needs] if needs in has else needs in low):
            continue
        out += [(kind, *m.span(m.lastindex)) for m in pattern.finditer(text)]
    sure = sorted({*(s for kind in base for s in kind), *((a, b) for kind, a, b in out if kind == "credential")})

    def covers(a: int, b: int) -> int:
        i = bisect_left(sure, (a, a))
        return int(i < len(sure) and sure[i][1] <= b)
    return [(kind, a, b, covers(a, b)) for kind, a, b in out]


class Trees:
    """Boosted trees as flat arrays; ``score`` gives the probability for rows of features."""

    def __init__(self, model):
        self.weights, self.trees = list(model.treeWeights), []
        for tree in model.trees:
            nodes: list = []
            self._walk(tree._java_obj.rootNode(), nodes)
            self.trees.append([np.array(x) for x in zip(*nodes)])

    def _walk(self, node, nodes: list) -> int:
        at = len(nodes)
        nodes.append(None)
        if node.subtreeDepth() == 0:
            nodes[at] = (-1, 0.0, at, at, float(node.prediction()))
        else:
            split = node.split()
            left, right = self._walk(node.leftChild(), nodes), self._walk(node.rightChild(), nodes)
            nodes[at] = (split.featureIndex(), float(split.threshold()), left, right, 0.0)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for weight, (feature, threshold, left, right, value) in zip(self.weights, self.trees):
            at = np.zeros(len(x), dtype=np.int64)
            while (feature[at] >= 0).any():
                go_left = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(feature[at] >= 0, np.where(go_left, left[at], right[at]), at)
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * total))


def _training_rows(batches):
    for batch in pieces(batches):
        x, y, fold = [], [], []
        for key, text in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            for kind, a, b, label in candidates(text, base_spans(text)):
                x.append(list(map(float, features(text, kind, a, b))))
                y.append(label)
                fold.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(fold, pa.int32())],
                                         ["x", "label", "fold"])


def _scored(trees: Trees):
    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(trees.score(x)), batch.column("label")], ["score", "label"])
    return run


def lowest(held: DataFrame, precision: float) -> float | None:
    """Lowest score of held(score, label) from which on upwards the wanted share has label 1; None if there is none."""
    points = checkpointed(held.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("hit"))).select(
        "*", (-F.col("score")).alias("down"), F.floor(-F.col("score") * BUCKETS).alias("bucket"))
    ran = running_total(points, [], "bucket", ["down"], {"n_above": "n", "hit_above": "hit"})
    return ran.where((F.col("hit_above") + F.col("hit")) / (F.col("n_above") + F.col("n")) >= precision).agg(F.min("score")).first()[0]


def fit(docs: DataFrame, precision: float = PRECISION) -> tuple[Trees, float] | None:
    """Trees and threshold from all documents; None when the part to learn from shows only one class."""
    rows = docs.select("text", (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4)) == 0).cast("int").alias("fold"))
    spans = checkpointed(rows.mapInArrow(_training_rows, "x array<double>, label int, fold int"))
    seen = {(r["fold"], r["label"]) for r in spans.select("fold", "label").distinct().collect()}
    if not {(0, 0), (0, 1)} <= seen:
        return None
    train = spans.where("fold = 0").select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    trees = Trees(GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=3, maxMemoryInMB=64).fit(train))
    if not any(fold for fold, _ in seen):
        return trees, 0.5
    low = lowest(spans.where("fold = 1").select("x", "label").mapInArrow(_scored(trees), "score double, label int"), precision)
    return trees, 1.1 if low is None else max(0.5, low)


def _found(model):
    def run(batches):
        for batch in pieces(batches):
            ids, counts, digests, spans = batch.column("doc_id"), [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                taken = [(k, a, b) for k, kind in enumerate(base) for a, b in kind]
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in taken).encode()).hexdigest())
                counts.append([len(kind) for kind in base])
                more = candidates(text, base) if model else []
                if more:
                    score = model[0].score(np.array([features(text, kind, a, b) for kind, a, b, _ in more], dtype=np.float64))
                    taken += best(more, score, model[1], [(a, b) for _, a, b in taken])
                spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(taken)))
            counts = np.array(counts, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in counts.T], pa.array(digests), pa.array(spans)],
                                             ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])
    return run


def best(more: list, score: np.ndarray, threshold: float, taken: list) -> list:
    """Candidates over the threshold, best first, that overlap nothing taken before."""
    starts: list = []
    for a, b in sorted(taken):  # base spans of two kinds may overlap
        if starts and starts[-1][1] > a:
            starts[-1] = (starts[-1][0], max(b, starts[-1][1]))
        else:
            starts.append((a, b))
    out = []
    for i in np.lexsort((np.arange(len(score)), -score)):
        if score[i] < threshold:
            break
        kind, a, b, _ = more[i]
        at = bisect_left(starts, (a, b))
        if (at < len(starts) and starts[at][0] < b) or (at and starts[at - 1][1] > a):
            continue
        starts.insert(at, (a, b))
        out.append((KINDS.index(kind), a, b))
    return out


def find_personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = fit(docs, precision)
    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return docs.mapInArrow(_found(model), f"doc_id bigint, {counts}, base_sha256 string, spans string")


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    return find_personal_data(read(spark, sf_dir, "documents"))
