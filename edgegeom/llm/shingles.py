"""Word shingles of texts as sorted sets of 64-bit hashes, made with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WIDTH = 5
#: Words whose hashes a task keeps; the store is emptied when it is full.
KEPT_WORDS = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns a text into the sorted distinct hashes of its shingles of lower-case words.

    A text of fewer words than a shingle has is one shingle; one without a word has none.
    """

    def __init__(self, width: int = WIDTH):
        self.width, self.hashes = width, {}
        self.odd = np.resize(_ODD, width) * np.arange(1, 2 * width, 2, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.hashes
        try:
            each = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(known) > KEPT_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            each = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        total = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            total = mix(total + each[i : i + n] * self.odd[i])
        return np.unique(total)
