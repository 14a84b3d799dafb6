"""Polynomial hashes of stretches of a byte array from running sums, all stretches at once.

The hash of bytes from a to b is the sum of code[byte] * base**(place - a) modulo 2**64, which is
the difference of two running sums times the inverse power of a. Each base and table of codes makes
a hash of its own.
"""

from __future__ import annotations

import numpy as np

_FIXED = np.random.default_rng(20_260)
LETTER_CODES = _FIXED.integers(1, 1 << 63, (2, 256), np.uint64)
BASES = [int(b) | 1 for b in _FIXED.integers(1 << 40, 1 << 62, 2)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            for i, base in enumerate(self.bases):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                self.tables[i] = np.cumprod(steps, dtype=np.uint64)
        return self.tables

    def sums(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``codes`` from each start to each end."""
        power, inverse = self.upto(len(codes) + 1)
        so_far = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * power[: len(codes)], out=so_far[1:])
        return (so_far[ends] - so_far[starts]) * inverse[starts]


def word_hashes(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int, powers: Powers) -> np.ndarray:
    """A hash of the bytes of each word that starts and ends there."""
    own = powers.sums(LETTER_CODES[which][letters], starts, ends)
    return mixed(own + (ends - starts).astype(np.uint64))
