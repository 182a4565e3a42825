"""Hashed word shingles of whole texts, in numpy over Arrow batches.

Words are runs of anything but the six ASCII white-space characters, A-Z lower-cased; ``bytes.split`` and
``bytes.lower`` have exactly these rules.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers, one for each place of a shingle (drawn once, from the digits of a fixed seed).
_PLACES = np.random.default_rng(20240607).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_MAX_WORDS = 100_000


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it gets large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits (the public splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct uint64 hashes of the shingles; a shorter text is one shingle, no words give an empty set."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = len(h) - words + 1
    if n < 1:
        return mix((h * _PLACES[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    total = h[:n] * _PLACES[0]
    for i in range(1, words):
        total += h[i : n + i] * _PLACES[i]
    return np.unique(mix(total + np.uint64(words)))
