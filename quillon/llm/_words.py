"""Vectorised words: positions and 64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of many texts at once.

A text is its UTF-8 bytes, where the six separators are single bytes. Hashes come from one running sum over a block:
the sum of table[byte] * r^i (mod 2^64), whose differences, scaled back by r^-start, hash any slice in constant time.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_seeded = np.random.Generator(np.random.PCG64(20240601))
_TABLE = _seeded.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, BLOCK + 64)
        with np.errstate(over="ignore"):
            have = np.full(size, _R if kind == "up" else _RINV, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        if size <= 8 * BLOCK:  # a single huge text must not leave its tables behind
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


class Block:
    """Words of the texts in data, cut at offsets; lower folds A-Z."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets, n = data, offsets, len(data)
        self.folded = _LOWER[data] if lower else data
        self.space = SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.ones(n + 1, bool)
        before[1:] = self.space
        here = np.ones(n + 1, bool)
        here[:n] = self.space
        self.starts = np.flatnonzero(~here & (before | cut))
        self.ends = np.flatnonzero(~before & (here | cut))
        self.bounds = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.bounds)
        self._sum = None

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes from starts to ends (exclusive)."""
        with np.errstate(over="ignore"):
            if self._sum is None:
                self._sum = np.zeros(len(self.data) + 1, np.uint64)
                np.cumsum(_TABLE[self.folded] * _power("up", len(self.data)), out=self._sum[1:])
            found = (self._sum[ends] - self._sum[starts]) * _power("down", len(self.data) + 1)[starts]
            return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.slices(self.starts, self.ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a flag or number for each byte, by text."""
        run = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def per_words(self, values: np.ndarray) -> np.ndarray:
        """Sums of an integer for each word, by text."""
        run = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=run[1:])
        return run[self.bounds[1:]] - run[self.bounds[:-1]]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the hash of the size words from it on, and whether they all belong to its text."""
    n = len(hashes)
    whole = np.zeros(n, bool)
    if n < size:
        return np.zeros(n, np.uint64), whole
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out[: n - size + 1] = (out[: n - size + 1] + hashes[k : n - size + 1 + k]) * np.uint64(0x9FB21C651E98DF25 + 2 * k)
            out[: n - size + 1] ^= out[: n - size + 1] >> np.uint64(31)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    whole = left >= size
    return mix(out), whole


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether a key occurs more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice
