"""64-bit hashes of words, and of runs of them, by whole arrays."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 250_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """word to its hash; a worker hashes a word once, and starts anew beyond CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def word_hashes(text: bytes | None, *end: int) -> np.ndarray:
    """uint64 hashes of a text's words (A-Z lower-cased, cut at [\\x20\\x09-\\x0D]+), then end."""
    words = (text or b"").lower().split()
    out = np.empty(len(words) + len(end), dtype=np.uint64)
    out[: len(words)] = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    out[len(words) :] = end
    return out
