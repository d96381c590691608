"""Shingle sets of texts and their MinHash signatures, vectorised over many texts at once."""

from __future__ import annotations

import math

import numpy as np
import xxhash

from .common import WORD

N = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Word hashes that a worker remembers.
WORDS = 150_000


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of n words; a shorter text has one shingle of all its words, a text
    without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _MULTIPLIER + w[i : len(w) - k + 1 + i]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds pairs at the threshold with the target recall within
    `most` hash functions, that is the most rows in a band."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


class MinHash:
    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of uint32 minima for each set; no set may be empty."""
        flat = np.concatenate(sets)
        x = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), len(self.a)), np.uint32)
        for k in range(len(self.a)):
            y = x * self.a[k] + self.b[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x85EBCA6B)
            out[:, k] = np.minimum.reduceat(y, starts)
        return out
