import random

from tokenizers import Tokenizer
from tokenizers.models import Unigram

from threatloom.llm import token_counts as C


def plain(word, scores):
    """Best (score, fewest tokens) over all cuts of one word."""
    word = C.MARK + word
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        ways = [] if word[i - 1] in scores else [(best[i - 1][0] + n * C.BYTE_SCORE, -(-best[i - 1][1] + n))]
        ways = [(s, t) for s, t in ways]
        for k in range(1, i + 1):
            s = scores.get(word[i - k:i])
            if s is not None:
                ways.append((best[i - k][0] + s, best[i - k][1] + 1))
        best.append(min(ways, key=lambda w: (-w[0], w[1])))
    return best[-1][1]


SCORES = C.load_vocabulary()
WORDS = ["the", "unbelievable", "Straße", "ciónñ", "aaaaaaaaaaaaaaaaaaa", "😀x", "日本語", "1234567", "x" * 63, "x" * 64, "ab" * 200, "internationalisation", "▁", "é"]


def test_trie_against_plain_recurrence(monkeypatch):
    random.seed(4)
    words = WORDS + ["".join(random.choices("abcdeñß😀. 日"[:9], k=random.randint(1, 80))) for _ in range(300)]
    for nodes, long in ((300_000, 64), (40, 64), (300_000, 5)):
        monkeypatch.setattr(C, "NODES", nodes)
        monkeypatch.setattr(C, "LONG", long)
        counter = C.Counter(SCORES)
        assert [counter[w] for w in words] == [plain(w, SCORES) for w in words]


def test_ties_do_not_depend_on_the_limits(monkeypatch):
    scores = {"a": -1.0, "aa": -2.0, "aaa": -3.0, C.MARK: -0.1, "ab": -2.5, "b": -1.5, "ba": -2.5}
    words = ["a" * k for k in range(1, 200, 7)] + ["ab" * k for k in range(1, 90, 7)] + ["aab" * 50]
    made = []
    for nodes, long in ((300_000, 1000), (300_000, 4), (5, 1000), (10, 64)):
        monkeypatch.setattr(C, "NODES", nodes)
        monkeypatch.setattr(C, "LONG", long)
        counter = C.Counter(scores)
        made.append([counter[w] for w in words])
    assert made[0] == [plain(w, scores) for w in words] and all(m == made[0] for m in made)


def test_against_a_unigram_tokenizer():
    vocabulary = [("<unk>", -1000.0), *SCORES.items()]
    model = Tokenizer(Unigram(vocabulary, 0))
    counter = C.Counter(SCORES)
    words = [w for w in WORDS if all(c in SCORES for c in w)] + ["hello", "tokenization", "preposterous", "Kraftfahrzeug", "ingnd", "whea", "thntrean"]
    assert len(words) > 10
    assert [counter[w] for w in words] == [len(model.encode(C.MARK + w).ids) for w in words]


def test_query_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    memo = {}
    rows = C.op2_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[:60]:
        words = C.PRE_TOKEN.findall(texts[r["doc_id"]])
        for w in words:
            memo[w] = memo[w] if w in memo else plain(w, SCORES)
        assert (r["n_pre_tokens"], r["n_tokens"]) == (len(words), sum(memo[w] for w in words))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, " \t\n", 0), (None, "the the", 0), (3, "a" * 300_000, 0), (3, "a" * 300_000, 0)],
                                 "doc_id int, text string, n_tokens int")
    rows = sorted((r["doc_id"] or -1, r["n_pre_tokens"], r["n_tokens"]) for r in C.count_tokens(docs).collect())
    assert rows[:4] == [(-1, 2, 2), (1, 0, 0), (2, 0, 0), (2, 0, 0)] and rows[4] == rows[5]
    assert C.count_tokens(docs.limit(0)).count() == 0
