"""Vectorised hashes of the words of UTF-8 texts, of their n-grams and of windows of words."""

from __future__ import annotations

import numpy as np

from helixsieve.llm.common import SPACE_BYTES

U = np.uint64
#: Odd multipliers, and the mixing constants of the public splitmix64 generator: fixed values.
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE_BYTES)] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(MIX[0])
    x = (x ^ (x >> U(27))) * U(MIX[1])
    return x ^ (x >> U(31))


class _Powers:
    """base ** i and base ** -i modulo 2 ** 64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_BYTES, _WORDS = _Powers(BASE), _Powers(STEP)


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hashes of values[start:end], from prefix sums."""
    up, down = powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and each word's start and end."""
    x = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_IS_WORD[x].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return x, edge[::2], edge[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    x, starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(_spans(x.astype(np.uint64) + U(1), starts, ends, _BYTES) + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(k)
    return mix(_spans(words, at, at + n, _WORDS))
