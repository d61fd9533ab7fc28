"""Suffix arrays of byte strings in numpy.

The order is refined as by Larsson and Sadakane: positions are sorted by eight
bytes, then each group of equals by the ranks of what follows, doubling the
depth; positions that stand alone are not touched again.  Common prefixes follow
Kasai: what position ``i`` shares with its neighbour, position ``i + d`` shares
with its own but for ``d`` bytes.  Strides of halving length take the place of
the loop over positions, so every step is an array operation.
"""

from __future__ import annotations

import numpy as np


def leading_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as a number, the first byte highest; zeros at the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out |= padded[i:i + len(data)].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def suffix_array(data: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """All positions of ``data`` in the order of the bytes from each to the end."""
    n = len(data)
    words = leading_words(data) if words is None else words
    order = np.argsort(words, kind="stable")
    place = np.arange(n)
    heads = np.empty(n, bool)
    heads[:1] = True
    heads[1:] = words[order[1:]] != words[order[:-1]]
    first = np.maximum.accumulate(np.where(heads, place, 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = first
    rank[n] = -1
    if (data == 0).any():
        order, rank = _separate_tail(order, rank, n)
    h = 8
    while h < n:
        ranks = rank[order]
        alone = np.ones(n + 1, bool)
        alone[1:n] = ranks[1:] != ranks[:-1]
        open_places = np.flatnonzero(~(alone[:-1] & alone[1:]))
        if not len(open_places):
            break
        members = order[open_places]
        follow = rank[np.minimum(members + h, n)] + 1
        key = rank[members] * (n + 2) + follow
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[open_places] = members
        heads = np.ones(len(members), bool)
        heads[1:] = key[1:] != key[:-1]
        rank[members] = open_places[np.maximum.accumulate(
            np.where(heads, np.arange(len(members)), 0))]
        h *= 2
    return order


def _separate_tail(order: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Put positions whose words run over the end before equal words that hold zero bytes."""
    key = rank[:n] * 9 + np.minimum(n - np.arange(n), 8)
    order = np.argsort(key, kind="stable")
    heads = np.ones(n, bool)
    heads[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank[n] = -1
    return order, rank


def _equal_bytes(difference: np.ndarray) -> np.ndarray:
    """How many leading bytes of two words agree, from their exclusive or."""
    out = np.zeros(len(difference), np.int64)
    for bits in range(0, 64, 8):
        out += difference < np.uint64(1 << bits) if bits else difference == 0
    return out


def common_prefixes(
    data: np.ndarray, order: np.ndarray, limit: int, words: np.ndarray | None = None,
) -> np.ndarray:
    """For each place of ``order`` the bytes shared with the place before it, up to ``limit``."""
    n = len(data)
    words = leading_words(data) if words is None else words
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)

    def extend(at: np.ndarray, known: np.ndarray) -> None:
        known = np.where(before[at] < 0, 0, known)
        live = np.flatnonzero(before[at] >= 0)
        while len(live):
            a, b, l = at[live], before[at[live]], known[live]
            room = np.minimum(n - np.maximum(a, b), limit)
            inside = l < room
            live, a, b, l = live[inside], a[inside], b[inside], l[inside]
            same = _equal_bytes(words[a + l] ^ words[b + l])
            known[live] = np.minimum(l + same, room[inside])
            live = live[same == 8]
        shared[at] = known

    stride = 64
    extend(np.arange(0, n, stride), np.zeros(len(range(0, n, stride)), np.int64))
    while stride > 1:
        half = stride // 2
        at = np.arange(half, n, stride)
        extend(at, np.maximum(shared[at - half] - half, 0))
        stride = half
    return shared[order]
