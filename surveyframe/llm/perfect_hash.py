"""Minimal perfect hashing of distinct 128-bit keys in numpy.

A cascade of bit arrays: every key that meets no other in an array of twice as
many bits as keys sets its bit there, all others go on to the next array.  The
number of bits set before a key's own is its place: the places of n keys are
0 to n - 1.  About 3.5 bits a key, and one rank for every 64 of them.
"""

from __future__ import annotations

import numpy as np

from .words import mix

BITS_PER_KEY = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _bit(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key in the array of a level."""
    with np.errstate(over="ignore"):
        seed = _STEP * np.uint64(level + 1)
        return ((mix(high ^ seed) + mix(low + seed)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Places of the keys it was built from; another key may get any place, or none."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    def __len__(self) -> int:
        return int(self.rank[-1])

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """From the two halves of distinct keys."""
        if len(np.unique(np.stack([high, low], 1), axis=0)) != len(high):
            raise ValueError("the keys of a perfect hash must be distinct")
        arrays, sizes = [], []
        while len(high):
            size = 64 * -(-BITS_PER_KEY * len(high) // 64)
            bit = _bit(high, low, len(sizes), size)
            alone = np.bincount(bit, minlength=size) == 1
            arrays.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = ~alone[bit]
            high, low = high[rest], low[rest]
        return cls(np.concatenate(arrays) if arrays else np.zeros(0, np.uint64),
                   np.array(sizes, np.int64))

    def places(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(high), -1, np.int64)
        going = np.arange(len(high))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(going):
                break
            bit = _bit(high[going], low[going], level, size) + self.first[level]
            word, inside = bit >> 6, (bit & 63).astype(np.uint64)
            here = (self.bits[word] >> inside) & np.uint64(1) == 1
            word, inside = word[here], inside[here]
            below = self.bits[word] & ((np.uint64(1) << inside) - np.uint64(1))
            out[going[here]] = self.rank[word] + np.bitwise_count(below)
            going = going[~here]
        return out
