"""Words of texts as bytes, and hashes of word shingles, many texts at a time."""

from functools import lru_cache

import numpy as np

#: Bytes that are not part of a word become spaces, A-Z become a-z.
FOLD = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

#: Bytes between words in the sense of ``[^\x20\x09-\x0D]+``, as spaces; A-Z become a-z.
FOLD_SPACE = bytes(32 if c == 0x20 or 0x09 <= c <= 0x0D else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at a time.
BLOCK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


def block_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a block of bytes that ends with a space.

    A word's hash is a polynomial in its bytes, cut out of running sums over all
    bytes, so that numpy sees them once.
    """
    edge = np.flatnonzero(np.diff((raw != 32).view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    size = max(BLOCK, len(raw))
    with np.errstate(over="ignore"):
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE[raw] * powers(int(BASE), size)[:len(raw)], out=run[1:])
        return mixed((run[ends] - run[starts]) * powers(int(INVERSE), size)[starts]), starts


def word_hashes(texts: list[bytes], fold: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and each text's number of words."""
    raw = np.frombuffer((b" ".join(texts) + b" ").translate(fold), dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = at + BLOCK
        if end < len(raw):
            spaces = np.flatnonzero(raw[at:end] == 32)
            end = at + int(spaces[-1]) + 1 if len(spaces) else end + int(np.argmax(raw[end:] == 32)) + 1
        h, s = block_hashes(raw[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    upto = np.searchsorted(np.concatenate(starts), np.cumsum([len(t) + 1 for t in texts]))
    return np.concatenate(hashes), np.diff(upto, prepend=0)


def shingles(texts: list[bytes], fold: bytes, size: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted within each text) and each text's number of them.

    A text with fewer words has its whole sequence as one shingle, or none if
    ``short`` is False; a text without words has none.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words, counts = word_hashes(texts, fold)
    first = np.cumsum(counts) - counts
    number = np.where(counts >= size, counts - size + 1, (counts > 0) * short)
    owner = np.repeat(np.arange(len(texts)), number)
    at = first[owner] + np.arange(len(owner)) - (np.cumsum(number) - number)[owner]
    length = np.minimum(counts, size)[owner]
    out = np.zeros(len(owner), np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    with np.errstate(over="ignore"):
        for k in range(size):
            out = np.where(k < length, (out + padded[at + k]) * STEP, out)
        out = mixed(out ^ length.astype(np.uint64))
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.bincount(owner[new], minlength=len(texts)).astype(np.int64)
