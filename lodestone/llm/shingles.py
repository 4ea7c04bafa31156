"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 2**64))
#: For bytes.translate, which is faster than an index: 1 in words, 3 in a word's character after its first byte.
IS_WORD = np.zeros(256, np.uint8)
IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = 1
IS_WORD[0x80:0xC0] = 3
IS_WORD[0xC0:] = 1
IS_WORD = IS_WORD.tobytes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64 = STEP) -> np.ndarray:
    if n > 1 << 16:
        out = np.full(n, base)
        out[0] = 1
        return np.multiply.accumulate(out)
    return first_powers(base)[: max(1, n)]


@lru_cache
def first_powers(base: np.uint64) -> np.ndarray:
    out = np.full(1 << 16, base)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the text each is in.

    A word is a run of ASCII letters and digits or of non-ASCII characters,
    after lower-casing.
    """
    return measured_words(texts)[:2]


def measured_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hashed_words`` and the number of characters of each word."""
    raw = "\n".join(["", *texts, ""]).lower().encode("utf-8", "surrogatepass")  # a line's end is a text's end to lower()
    data = np.frombuffer(raw, np.uint8)
    kind = np.frombuffer(raw.translate(IS_WORD), np.uint8)
    word = (kind & 1).view(bool)
    change = np.flatnonzero(word[1:] != word[:-1]) + 1
    if not len(change):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends = change[::2], change[1::2]
    lengths = ends - starts
    # a word's sum is the difference of two running sums, modulo 2**64, moved back to the word's start
    total = np.cumsum(BYTE_MIX[data] * powers(len(data)))
    hashes = mix((total[ends - 1] - total[starts - 1]) * powers(len(data), BACK)[starts] + lengths.astype(np.uint64))
    tails = np.flatnonzero(kind & 2)
    chars = lengths - np.bincount(np.searchsorted(starts, tails, side="right") - 1, minlength=len(starts))
    bounds = np.flatnonzero(data == 10)[1:]
    if len(bounds) != len(texts):  # texts of several lines
        bounds = np.cumsum([len(t.lower().encode("utf-8", "surrogatepass")) + 1 for t in texts])
    upto = np.searchsorted(starts - 1, bounds)
    return hashes, np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0)), chars


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer words has one shingle, of all its words; one without
    words has none.
    """
    hashes, owner = hashed_words(texts)
    n = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(n)
    weight = powers(words + 1)[1:]
    rolled = np.zeros(0, np.uint64)
    if len(hashes) >= words:
        rolled = hashes[: len(hashes) - words + 1] * weight[0]
        for k in range(1, words):
            rolled = rolled + hashes[k : len(hashes) - words + 1 + k] * weight[k]
        rolled = mix(rolled)
    out = []
    for count, end in zip(n.tolist(), ends.tolist()):
        if count >= words:
            out.append(np.unique(rolled[end - count : end - words + 1]))
        elif count:
            out.append(mix((hashes[end - count : end] * weight[:count]).sum(keepdims=True) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each pair of sets has in common (float32, exact below 2**24), in bounded memory."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(values), -1)
    number[shared] = np.arange(len(shared))
    column = number[place]
    inside = column >= 0
    owner, column = owner[inside], column[inside]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), dtype=np.float32)
    cuts = np.searchsorted(column, np.arange(0, len(shared) + columns, columns))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        has = np.zeros((n, min(columns, len(shared) - k * columns)), dtype=np.float32)
        has[owner[a:b], column[a:b] - k * columns] = 1
        out += has @ has.T
    return out
