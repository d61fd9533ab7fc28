"""The softmax and the gradient step of the language model, against plain ways to compute them."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from surveyframe.llm import maxent as M


def some(size: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(size))


def test_a_step_adds_up_the_errors_of_each_row():
    random = some(1)
    row = np.concatenate((np.full(9_000, 7), np.repeat(np.arange(100, 140), 300),
                          np.repeat(np.arange(200, 210), [1, 2, 62, 63, 64, 65, 66, 126, 127, 128]),
                          random.permutation(np.arange(1_000, 5_000)))).astype(np.uint16)
    row = random.permutation(row)
    other = row[::-1].copy()
    error = (random.random((len(row), M.PER_CLASS)) - 0.3).astype(np.float32)
    table = random.random((1 << 13, M.PER_CLASS)).astype(np.float32)
    learner = M._Learner(table)
    learner.step([row, other], error)

    wanted, squares = table.astype(np.float64), np.ones(len(table))
    for names in (row, other):
        slope = np.zeros(table.shape)
        np.add.at(slope, names, error.astype(np.float64))
        squares += (slope ** 2).mean(axis=1)
        wanted -= M._RATE * slope / np.sqrt(squares)[:, None]
    assert np.allclose(learner.table, wanted, rtol=0, atol=1e-5)
    assert np.allclose(learner.squares, squares, rtol=1e-4)
    assert (learner.seen == 2 * np.bincount(row, minlength=len(table))).all()


def test_logits_beyond_the_range_of_floats():
    random = some(2)
    table = (random.random((64, M.CLASSES)) - 0.5).astype(np.float32)
    table[1], table[2], table[3, 5] = 400, -400, 900
    rows = [np.arange(64), np.arange(64)]
    constants = np.zeros(M.CLASSES, np.float32)
    constants[9] = -1e9
    own = random.integers(0, 9, 64)
    logits = 2 * table.astype(np.float64) + constants
    most = logits.max(axis=1)
    log = most + np.log(np.exp(logits - most[:, None]).sum(axis=1))
    wanted = logits[np.arange(64), own] - log
    assert np.allclose(M._log_shares(own, table, rows, constants), wanted, rtol=1e-5, atol=1e-5)
    shares, total = M._softmax(M._sums(table, rows, constants))
    assert np.allclose(shares, np.exp(logits - log[:, None]), atol=1e-6)
    assert np.allclose(total, log, rtol=1e-5)


def test_scores_hold_few_logits_at_once():
    """The logits of a whole step do not fit a processor's cache."""
    size = 1 << 15
    random = some(3)
    tokens = random.integers(0, 1 << 40, size).astype(np.uint64)
    numbers = random.integers(0, 900, size)
    weights = M.Weights.start(np.full(900, 10), 10_000)
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    M.token_scores(tokens, np.zeros(1, np.int64), numbers, weights)
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert most < 2 * size * M.CLASSES * 4  # of float32


def test_groups_of_any_size_have_the_softmax_of_their_tokens():
    """Groups of no, one, few and more tokens than a row of weights has places, packed as bytes."""
    random = some(4)
    sizes = [3, 1, 40, 32, 33, 70]
    lists = [[{"token": 1_000 * g + i, "n": int(random.integers(1, 50))} for i in range(size)]
             for g, size in enumerate(sizes)]
    column = pa.array([[], *lists], pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())])))[1:]
    none = pa.nulls(1, pa.binary())
    tokens, counts = (pa.concat_arrays([M._packed(column, c), none]) for c in ("token", "n"))
    wanted = [1_000 * g + size - 1 for g, size in enumerate(sizes)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([*range(len(sizes)), 99]), pa.array([*wanted, 5]), tokens, counts,
         *(pa.array(random.integers(0, 1 << 60, len(sizes) + 1)) for _ in range(3))],
        ["group", "token", "member_tokens", "member_counts", "f0", "f1", "f2"])
    table = np.zeros((M.GROUP_ROWS, M.PER_CLASS), np.float32)
    logits, place, n, rows = M._group_logits(batch.slice(1), table)
    shares = M._softmax(logits)[0]
    assert place.tolist() == [size - 1 for size in sizes[1:]] + [-1]
    assert n.tolist() == [held[-1]["n"] for held in lists[1:]] + [0]
    for found, held in zip(shares, lists[1:]):
        of = np.array([m["n"] for m in held]) + M.SMOOTHING
        assert np.allclose(found[:len(of)], of / of.sum(), rtol=1e-5)
        assert not found[len(of):].any()
    assert [which.tolist() for which, _, _ in rows] == [[0, 1, 2, 3, 4, 5], [1, 3, 4], [4]]
