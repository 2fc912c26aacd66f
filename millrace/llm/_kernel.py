"""Vectorised byte kernels: rolling hashes, word hashes and run lengths over many texts at once.

All hashes work modulo 2**64 on concatenated texts; a value depends only on
the bytes it covers, never on where the text lies in a batch.
"""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


@functools.cache
def byte_values(seed: int = 0) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix(np.arange(1 + 1000 * seed, 257 + 1000 * seed, dtype=U64) * U64(0xD6E8FEB86659FD93))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = BASES[which]
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 22:
            _powers[which] = have
    return have


class Spans:
    """Hashes of arbitrary byte ranges of ``data`` in constant time each."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.up, self.down = powers(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(byte_values(which)[data] * self.up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def kgrams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes at each start; len(data) - k + 1 values."""
    if len(data) < k:
        return np.zeros(0, U64)
    base, done, out = BASES[0], 0, None
    level, size = byte_values()[data], 1
    n = len(data) - k + 1
    while True:
        if k & size:
            part = level[done : done + n]
            out = part if out is None else out * U64(pow(base, size, 1 << 64)) + part
            done += size
        if size * 2 > k:
            return mix(out)
        level = level[:-size] * U64(pow(base, size, 1 << 64)) + level[size:]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i; len(x) - w + 1 values."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def owners(offs: np.ndarray) -> np.ndarray:
    """The row of each byte."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


WORD = np.zeros(256, bool)  #: bytes of words: ASCII letters and digits, and all of other scripts
WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of word bytes; no word crosses a row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    start = np.flatnonzero(m & (~before | edge[:-1]))
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    end = np.flatnonzero(m & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as maximal disjoint ones, in order; touching ranges join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[new[1:], True]]
