"""Words and shingles of many texts at once, as 64-bit hashes in numpy.

A batch of texts is one array of bytes with the offset of each text.  A word is
a run of allowed bytes inside one text, after A-Z became a-z; the bytes of other
UTF-8 letters are always allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
# Sums of powers modulo 2^64 collide on regular strings of 1,024 bytes and more, whatever the base; a
# word longer than this is known by its BLAKE2 digest instead.
LONG_WORD = 64

_random = np.random.Generator(np.random.PCG64(20_240_601))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text
LETTER_OR_DIGIT = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    LETTER_OR_DIGIT[_low:_high + 1] = False

_SYMBOL = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_random.integers(1, 1 << 62)) * 8 + 5
_ORDER = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: str, size: int) -> np.ndarray:
    """Powers of the base, or of its inverse, modulo 2^64."""
    if len(_powers[which]) < size:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        factors = np.full(max(size, PIECE_BYTES + 1), base & (2**64 - 1), np.uint64)
        factors[0] = 1
        _powers[which] = np.cumprod(factors)
    return _powers[which][:size]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_SYMBOL[data] * _power("up", len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of bytes start to end; equal spans have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _power("down", len(sums))[starts])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as bytes, and the offsets; a missing text is empty."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
    if content is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(content, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES,
) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts fill about ``limit`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def word_places(
    data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each text."""
    inside = allowed[data]
    size = len(inside)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < size]
    first[edges] = inside[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def digest(strings: Iterator[bytes]) -> np.ndarray:
    """64 bits of the BLAKE2 digest of each string."""
    return np.frombuffer(
        b"".join([blake2b(s, digest_size=8).digest() for s in strings]), "<u8").astype(np.uint64)


def word_hashes(column: pa.Array, allowed: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the number of the first word of each text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, bounds = word_places(data, offsets, allowed)
    if not len(data):
        return np.zeros(0, np.uint64), bounds
    hashes = span_hash(rolling(data), starts, ends)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        hashes[long] = digest(data[a:b].tobytes() for a, b in zip(starts[long], ends[long]))
    return hashes, bounds


def shingle_hashes(
    words: np.ndarray, bounds: np.ndarray, width: int, *, short: bool = True,
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words, and the number of the first run of each text.

    With ``short`` a text of fewer words has one shingle, the whole sequence;
    otherwise it has none.  A text without words has none.
    """
    n = np.diff(bounds)
    sizes = np.where(n >= width, n - width + 1, (n > 0) & short)
    out = np.empty(sizes.sum(), np.uint64)
    enough = np.repeat(n >= width, sizes)
    if enough.any():
        total = len(words) - width + 1
        sums = np.zeros(total, np.uint64)
        for j in range(width):
            sums += words[j:total + j] * _ORDER[j]
        valid = np.arange(total) + width <= np.repeat(bounds[1:], n)[:total]
        out[enough] = mix(sums[valid])
    few = np.flatnonzero((n > 0) & (n < width)) if short else np.zeros(0, np.int64)
    if len(few):
        sums = np.zeros(len(few), np.uint64)
        for j in range(width - 1):
            has = n[few] > j
            sums[has] += words[bounds[few[has]] + j] * _ORDER[j]
        out[~enough] = mix(sums ^ (n[few].astype(np.uint64) << np.uint64(56)))
    return out, np.concatenate(([0], np.cumsum(sizes)))
