"""Hashes of words and character n-grams of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: ASCII white space as in [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words (runs without ASCII white space) of a list of UTF-8 texts.

    ``start``, ``end``: byte places in ``data``; ``doc``: index of the text;
    ``hash``: 64-bit hash of the bytes.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.data = _LOWER[data] if lower else data
        n = len(data)
        self.doc_end = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1 if texts else np.zeros(0, np.int64)
        space = np.ones(n + 1, bool)
        space[1:] = SPACE[data]
        turns = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = turns[::2], turns[1::2]
        self.doc = np.searchsorted(self.doc_end, self.start, "right")
        self.count = len(texts)
        if n:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
            shift = _powers(_BASE_INVERSE, n)
            self.hash = mix64((sums[self.end] - sums[self.start]) * shift[self.start] + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def chars(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` bytes within a text, and their texts."""
        d, m = self.data, len(self.data) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        h = np.zeros(m, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) + d[i : m + i] + np.uint32(1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        doc = np.repeat(np.arange(self.count), np.diff(self.doc_end, prepend=-1))
        inside = doc[:m] == doc[n - 1 :]
        return h[inside], doc[:m][inside]
