"""Hashes of words and of runs of neighbouring words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

KNOWN_WORDS = 500_000
FACTOR = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


class WordHashes(dict):
    """64-bit hashes of words; those of recent words are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    @staticmethod
    @lru_cache(1)
    def shared() -> WordHashes:
        """One table for each Python worker."""
        return WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads neighbours."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, by where it begins; none if there are fewer words."""
    if n < 1 or len(words) < n:
        return np.empty(0, np.uint64)
    size = len(words) - n + 1
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = mixed(h * np.uint64(FACTOR) + words[k : k + size])
    return h
