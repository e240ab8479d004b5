"""Hashed word shingles of texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x09-\x0d\x20]+")
_TABLE = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (splitmix64)."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_table = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text; A-Z are lower-cased, words end at white space of ASCII."""
    if len(_table) > _TABLE:
        _table.clear()
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_table.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words, in order; of all words where there are fewer, of none where there are none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h *= _ODD
        h += words[i : n - width + 1 + i]
    return mix(h)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    return np.unique(shingle_hashes(word_hashes(text), k))
