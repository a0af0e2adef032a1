"""Token counts under a unigram vocabulary by dynamic programming over a shared trie.

A text is cut at white space into pre-tokens, each with a leading word mark. The
distinct ones are inserted in a trie; a node stands for a prefix, and its best
forward score is computed once, from the nodes up to the longest piece above it,
however many pre-tokens go through it. A terminal keeps the number of pieces of
the best path. A text's count is then a sum of lookups.

The trie lives in the task that reads the texts, so nothing is shuffled and no
hot word is gathered anywhere. It is dropped and started again at ``NODES``
nodes; a pre-token longer than ``LONG`` is computed with the same recurrence in a
rolling window instead, without nodes. Results do not depend on either limit.

The vocabulary is a public one, given by path and never trained here: its pieces
in their order of rank. The score of a piece is that of Zipf's law over this
order, -log(rank + 2.7), less a constant. A character that is no piece costs its
UTF-8 bytes, each one token, as with byte fallback. Of paths with equal score the
one with fewer tokens counts.

Defined results: null and empty texts have no pre-tokens and no tokens; repeated
rows repeat their result; an empty table gives no rows; other columns are
ignored; texts of any length are counted whole.
"""

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .common import pieces, read

MARK = "▁"
NODES, LONG = 600_000, 64
PRE_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Score of one byte of a character that is no piece; below that of any piece.
BYTE_SCORE = -30.0
ABSENT = object()


def load_vocabulary(path: str | None = None) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model file; by default the public 32k pieces."""
    import sentencepiece

    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(names))))
    return {name: -math.log(rank + 2.7) - norm for rank, name in enumerate(names)}


def endings(scores: dict[str, float]) -> dict[str, float | None]:
    """Every ending of a piece: with its score if it is a piece itself, else None."""
    out: dict = {}
    for piece in scores:
        for k in range(1, len(piece)):
            out.setdefault(piece[k:], None)
        out[piece] = scores[piece]
    return out


class Counter(dict):
    """Tokens by pre-token, filled on demand from the trie."""

    def __init__(self, scores: dict[str, float]):
        self.table, self.longest = endings(scores), max(map(len, scores), default=0)
        self.start()

    def start(self):
        self.clear()
        #: Children by node and character; of each node the best forward score and the tokens of that path.
        self.down, self.best, self.tokens = {}, [0.0], [0]

    def __missing__(self, word: str) -> int:
        marked = MARK + word
        if len(marked) > LONG:
            return rolled(marked, self.table, self.longest)
        if len(self.best) > NODES:
            self.start()
        down, best, tokens, table = self.down, self.best, self.tokens, self.table
        node, path = 0, [0]
        for c in marked:  # the prefix that the trie has
            node = down.get(node * 0x110000 + ord(c))
            if node is None:
                break
            path.append(node)
        for i in range(len(path) - 1, len(marked)):  # below a new node all are new
            node = len(best)
            down[path[i] * 0x110000 + ord(marked[i])] = node
            top, count = step(marked, i, table, best, tokens, path)
            best.append(top)
            tokens.append(count)
            path.append(node)
        self[word] = count = tokens[path[-1]]
        return count


def step(marked: str, i: int, table: dict, best: list, tokens: list, at: list) -> tuple[float, int]:
    """Best score of marked[:i + 1] and its tokens, over all last pieces from the shortest to the longest.

    ``at[j]`` is where the lists have marked[:j]. What is no ending of a piece
    ends the search, as nothing longer can be a piece.
    """
    up, end = at[i], i + 1
    s = table.get(marked[i])
    if s is None:
        n = len(marked[i].encode("utf-8", "surrogatepass"))
        top, count = best[up] + n * BYTE_SCORE, tokens[up] + n
    else:
        top, count = best[up] + s, tokens[up] + 1
    while i:
        i -= 1
        s = table.get(marked[i:end], ABSENT)
        if s is None:
            continue
        if s is ABSENT:
            break
        up = at[i]
        s += best[up]
        if s > top or s == top and tokens[up] + 1 < count:
            top, count = s, tokens[up] + 1
    return top, count


def rolled(marked: str, table: dict, longest: int) -> int:
    """The same recurrence over one text, keeping the last ``longest`` positions and more."""
    best, tokens, start = [0.0], [0], 0
    for i in range(len(marked)):
        if len(best) > 4 * longest:
            start = i - longest
            best, tokens = best[-longest - 1:], tokens[-longest - 1:]
        top, count = step(marked[start:i + 1], i - start, table, best, tokens, range(len(best)))
        best.append(top)
        tokens.append(count)
    return tokens[-1]


def _counted(shared):
    def run(batches):
        counter = Counter(shared.value)
        for batch in pieces(batches):
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                found = PRE_TOKEN.findall(text) if text else []
                words.append(len(found))
                tokens.append(sum(map(counter.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                                             ["doc_id", "n_pre_tokens", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, vocabulary: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_pre_tokens, n_tokens) for every row of docs(doc_id, text); the vocabulary is broadcast, a fixed table."""
    scores = load_vocabulary() if vocabulary is None else vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _counted(shared), "doc_id bigint, n_pre_tokens bigint, n_tokens bigint")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(read(spark, sf_dir, "documents"))
