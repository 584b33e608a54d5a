"""Vectorised words, hashes and shingles of many texts at once, on their UTF-8 bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; with ``lower``,
A to Z count as a to z. All of these are single bytes in UTF-8, so whole columns of text are cut and hashed by a few
passes over one byte array, with no Python code for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidebook.llm.arrow import texts_buffer

#: The bytes of white space.
SPACES = (9, 10, 11, 12, 13, 32)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_RANDOM = np.random.default_rng(20240607)
_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_VALUE[list(SPACES)] = 0
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_BASE = 0x9E3779B97F4A7C13  # odd, and 3 modulo 4
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)
_STEP = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


#: Powers that a worker keeps; for a longer text they are computed anew.
_KEPT = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64, or more."""
    global _POWERS, _INVERSE
    if len(_POWERS) >= n:
        return _POWERS, _INVERSE
    n = max(n, min(2 * n, _KEPT))
    found = []
    with np.errstate(over="ignore"):
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            found.append(np.multiply.accumulate(steps, out=steps))
    if n <= _KEPT:
        _POWERS, _INVERSE = found
    return found[0], found[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which close values fall far apart."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """The words of the texts of an Arrow column.

    ``starts`` and ``ends`` are byte positions in ``data``, ``hashes`` 64-bit hashes, and ``first[i]`` to ``first[i + 1]``
    the words of text ``i``; ``offsets`` are the texts' own byte positions.
    """

    def __init__(self, column: pa.Array, lower: bool = True, hashed: bool = True):
        self.data, self.offsets = data, offsets = texts_buffer(column)
        n = len(data)
        word = ~_IS_SPACE[data]
        fresh = np.zeros(n + 1, bool)  # where a text starts
        fresh[offsets] = True
        joined = word[1:] & word[:-1] & ~fresh[1:n] if n else word  # a byte and the next are of one word
        edge = np.zeros(n, bool)
        edge[1:] = joined[: max(n - 1, 0)]
        self.starts = np.flatnonzero(word & ~edge)
        edge[:] = False
        edge[:-1] = joined[: max(n - 1, 0)]
        self.ends = np.flatnonzero(word & ~edge) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash(_LOWER if lower else _VALUE) if hashed else None

    def _hash(self, value: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, inverse = _powers(len(self.data) + 1)
        terms = value[self.data]
        terms *= power[: len(terms)]
        return mix(np.add.reduceat(terms, self.starts) * inverse[self.starts])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every ``size`` neighbouring words of one text, and their bounds for each text, as ``first``."""
        h = self.hashes
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(len(self.first), np.int64)
        s = h[:n].copy()
        for j in range(1, size):
            s += h[j : j + n] * _STEP[j]
        ok = np.ones(n, bool)
        inner = self.first[1:-1]
        for j in range(1, size):  # windows that reach over the end of a text
            at = inner - j
            ok[at[(at >= 0) & (at < n)]] = False
        counts = np.maximum(self.counts - size + 1, 0)
        return mix(s[ok]), np.concatenate([[0], np.cumsum(counts)])

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """As ``windows``, but a text of fewer words has its whole sequence as one shingle; without words it has none."""
        s, bounds = self.windows(size)
        few = np.flatnonzero((self.counts > 0) & (self.counts < size))
        if not len(few):
            return s, bounds
        extra = np.array([whole(self.hashes[self.first[i] : self.first[i + 1]]) for i in few], np.uint64)
        s = np.insert(s, bounds[few], extra)
        add = np.zeros(len(bounds), np.int64)
        np.add.at(add, few + 1, 1)
        return s, bounds + np.cumsum(add)


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash of a whole sequence of words, apart from those of windows."""
    n = len(hashes)
    steps = _STEP[np.arange(n) % 64] * np.uint64(2 * n + 1)
    return mix(np.array([np.add.reduce(hashes * steps) + np.uint64(n)], np.uint64))[0]


def sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, and their bounds."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
