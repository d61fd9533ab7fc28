"""Language-model scores by a hashed maximum-entropy model.

The most frequent tokens form classes of equal size; every other token belongs
to one further class, which a tree divides into classes of about equal counts
until each token stands alone.  A token's probability is that of its class given
the two words before it, times that of each step within the class.  All are
softmax models whose weights are found by hashing features: the word before, the
two words before, and the word before that one (a skip).  Only one unknown token
has a fixed share of the last class, so the model is a distribution over the
whole vocabulary and that token.

The tree's upper part is built from the counts of the known tokens, which every
task holds.  The tokens beyond them are dealt to groups by their hash; groups and
levels above them grow with the vocabulary, and the last step, inside a group, is
learnt and scored after a join with the groups' tokens and counts.

Counts are sums over the whole corpus.  The weights have a fixed size.  They are
trained by rounds: every task takes gradient steps over its own part of the
training texts, and the parts' weights are averaged, each row of weights by how
often each part has updated it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.store import stored
from . import words as W
from .ship import ship

CLASSES = 32
PER_CLASS = 32
CLASS_ROWS = 1 << 13
WORD_ROWS = 1 << 14
TREE_ROWS = 1 << 16
GROUP_ROWS = 1 << 14
TOKENS_PER_GROUP = 16  # at least, on average: no group is empty
ROWS_PER_BLOCK = 1_024
KNOWN_TOKENS = 1 << 18
SLOTS = 1 << 22
COUNTED_AT_ONCE = 4_000_000
TOKENS_PER_TRAINING_TASK = 4_000_000
SMOOTHING = 0.1
_STEP = 1 << 15
_BLOCK = 1 << 12  # rows of logits at a time, so that they stay in the processor's cache
_LEAST_TOTAL = 1e-30
_ADDED_APART = 64  # a row of weights that occurs as often in a step has a sum of its own
_RATE = 0.3

_END = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0xD1B54A32D192ED03)
_KINDS = np.array([0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, each followed by one end, and where the texts begin."""
    words, bounds = W.word_hashes(texts)
    ends = bounds[1:] + np.arange(len(texts))
    out = np.empty(len(words) + len(texts), np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[ends] = _END
    out[is_word] = words
    return out, np.concatenate(([0], ends + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: texts to token counts, summed over many texts at once."""
    held: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array(counts)], ["token", "n"])

    for batch in W.pieces(batches, "text"):
        held.append(token_hashes(batch.column("text"))[0])
        if sum(map(len, held)) >= COUNTED_AT_ONCE:
            yield row()
    if held:
        yield row()


@dataclass
class Counts:
    """``table`` (token, n) of all training tokens, their number and how many differ."""

    table: DataFrame
    tokens: int
    distinct: int
    known: np.ndarray = field(repr=False)  # hashes of the most frequent tokens, falling
    known_counts: np.ndarray = field(repr=False)
    rare: DataFrame = field(repr=False)  # the rows of ``table`` that are not known


def count_tokens(training: DataFrame) -> Counts:
    """Counts of every token of ``training`` (text), over all of it."""
    table = stored(training.select("text").mapInArrow(_count, "token bigint, n bigint").groupBy(
        "token").agg(F.sum("n").alias("n")), "token-counts")
    tokens, distinct = table.agg(F.sum("n"), F.count("*")).first()
    # The tokens of the highest bins of counts that hold no more than KNOWN_TOKENS.
    level = F.floor(F.log2("n") * 16)
    bins = table.groupBy(level.alias("bin")).count().orderBy(F.desc("bin")).collect()
    least, taken = None, 0
    for row in bins:
        if taken + row["count"] > KNOWN_TOKENS:
            break
        least, taken = row["bin"], taken + row["count"]
    frequent = table.where(level >= F.lit(least)) if least is not None else table.limit(0)
    rare = table.where(level < F.lit(least)) if least is not None else table
    rows = frequent.toArrow()
    hashes = rows["token"].to_numpy().view(np.uint64)
    counts = rows["n"].to_numpy()
    order = np.lexsort((hashes, -counts))
    return Counts(table, tokens or 0, distinct or 0, hashes[order], counts[order], rare)


class Lookup:
    """The known tokens by their hash: the log of the smoothed count, and the rank from 1."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.keys = np.concatenate((np.zeros(1, np.uint64), hashes))
        self.logs = np.concatenate(([0.0], np.log10(counts + SMOOTHING)))
        self.ranks = np.zeros(SLOTS, np.int32)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)  # the more frequent token keeps a slot
        self.ranks[slot[first]] = first + 1
        without = np.ones(len(hashes), bool)
        without[first] = False
        without = np.flatnonzero(without)
        order = np.argsort(hashes[without])
        self.other_ranks = (without[order] + 1).astype(np.int32)
        self.other_keys = hashes[without][order]
        self.model_counts = counts[:(CLASSES - 1) * PER_CLASS]

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its rank or 0, the log of its count, and its model number or 0."""
        rank = self.ranks[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)]
        rank[self.keys[rank] != tokens] = 0
        if len(self.other_keys):
            left = np.flatnonzero(rank == 0)
            at = np.searchsorted(self.other_keys, tokens[left])
            at[at == len(self.other_keys)] = 0
            same = self.other_keys[at] == tokens[left]
            rank[left[same]] = self.other_ranks[at[same]]
        return rank, self.logs[rank], np.where(rank <= len(self.model_counts), rank, 0)


class Tree:
    """The classes of the tokens outside the model: nodes of up to PER_CLASS children.

    ``counts`` are those of all known tokens, falling; ``rare`` further tokens with a
    count of ``rare_count`` in all are a child of the root, divided into groups.
    """

    def __init__(self, counts: np.ndarray, rare: int, rare_count: int):
        self.skipped = min(len(counts), (CLASSES - 1) * PER_CLASS)
        mass = counts[self.skipped:] + SMOOTHING
        size = len(mass)
        sums = np.concatenate(([0.0], np.cumsum(mass)))
        self.leaf, self.place = np.zeros(size, np.int32), np.zeros(size, np.int8)
        parents, places, constants = [], [], []
        waiting = [(0, size, -1, 0)]
        for start, end, parent, place in waiting:
            node = len(parents)
            parents.append(parent)
            places.append(place)
            kept = 1 if node == 0 and rare else 0  # the root's first child: the rare tokens
            most = PER_CLASS - kept
            if end - start <= most:
                bounds = np.arange(start, end + 1)
            else:
                goals = sums[start] + (sums[end] - sums[start]) * np.arange(1, most) / most
                bounds = np.unique(np.concatenate(
                    ([start], np.minimum(np.searchsorted(sums, goals), end), [end])))
            shares = np.zeros(PER_CLASS)
            if kept:
                shares[0] = rare_count + SMOOTHING * rare
            shares[kept:kept + len(bounds) - 1] = np.diff(sums[bounds])
            with np.errstate(divide="ignore"):
                constants.append(np.where(shares > 0, np.log(shares), -1e9))
            for child, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), kept):
                if b - a == 1:
                    self.leaf[a], self.place[a] = node, child
                else:
                    waiting.append((a, b, node, child))
        wanted = max(rare // TOKENS_PER_GROUP, min(rare, 1))
        self.levels = 0  # above the groups, each of PER_CLASS children but the first
        while PER_CLASS ** self.levels < wanted:
            self.levels += 1
        below = PER_CLASS ** max(self.levels - 1, 0)
        self.first = wanted // below
        self.groups = self.first * below
        even = np.zeros((2, PER_CLASS))
        even[1, self.first:] = -1e9
        self.nodes = len(parents)
        self.constants = np.concatenate((np.array(constants), even)).astype(np.float32)
        self.parents = np.array(parents, np.int32)
        self.places = np.array(places, np.int8)

    def group(self, tokens: np.ndarray) -> np.ndarray:
        """The group of each rare token."""
        return (W.mix(tokens ^ _KINDS[1]) % np.uint64(max(self.groups, 1))).astype(np.int64)

    def steps(self, tokens: np.ndarray, ranks: np.ndarray):
        """All steps of the tokens outside the model, down to a token or to a group.

        The token's place in ``tokens``, the node's name, its row of constants, the child.
        """
        found = []
        at = np.flatnonzero(ranks > self.skipped)
        place = ranks[at] - 1 - self.skipped
        node, child = self.leaf[place], self.place[place]
        rare = np.flatnonzero(ranks == 0)
        if len(rare) and self.groups:
            below = self.group(tokens[rare])
            for level in range(self.levels - 1, -1, -1):
                above, digit = (below // PER_CLASS, below % PER_CLASS) if level else (
                    np.zeros_like(below), below)
                found.append((rare, above + ((level + 1) << 48),
                              np.full(len(rare), self.nodes + (level == 0)), digit))
                below = above
            at = np.concatenate((at, rare))
            node = np.concatenate((node, np.zeros(len(rare), np.int32)))
            child = np.concatenate((child, np.zeros(len(rare), np.int8)))
        while len(at):
            found.append((at, node.astype(np.int64) + CLASSES, node, child))
            up = self.parents[node]
            inner = up >= 0
            at, child, node = at[inner], self.places[node[inner]], up[inner]
        if not found:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


@dataclass
class Weights:
    """Rows of weights of the classes, of their words, of the tree's nodes and of the groups,
    and the constants of the first two."""

    classes: np.ndarray
    words: np.ndarray
    class_constants: np.ndarray
    word_constants: np.ndarray
    tree: np.ndarray
    groups: np.ndarray

    @classmethod
    def start(cls, model_counts: np.ndarray, tokens: int) -> Weights:
        """No features yet: the constants give each token its share of the corpus."""
        table = np.zeros((CLASSES - 1) * PER_CLASS)
        table[:len(model_counts)] = model_counts
        table = table.reshape(CLASSES - 1, PER_CLASS)
        rest = max(tokens - table.sum(), 0) + SMOOTHING
        with np.errstate(divide="ignore"):
            # A place without a token has no probability.
            sums = np.concatenate(([rest], table.sum(axis=1)))
            constants = np.where(sums > 0, np.log(sums / sums.sum()), -1e9)
            inner = np.zeros((CLASSES, PER_CLASS))
            inner[1:] = np.where(table > 0, np.log(table), -1e9)
        return cls(np.zeros((CLASS_ROWS, CLASSES), np.float32),
                   np.zeros((WORD_ROWS, PER_CLASS), np.float32),
                   constants.astype(np.float32), inner.astype(np.float32),
                   np.zeros((TREE_ROWS, PER_CLASS), np.float32),
                   np.zeros((GROUP_ROWS, PER_CLASS), np.float32))


def _features(tokens: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Hash of each feature of each token's context."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = _START
    skip = np.empty_like(tokens)
    skip[1:] = before[:-1]
    skip[starts] = _START
    return [W.mix(before * _KINDS[0]), W.mix(skip * _KINDS[1]),
            W.mix(before * _KINDS[2] + skip * _KINDS[1])]


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of each row before they are divided by its sum, that sum, and the log of the whole sum.

    A row's largest logit is taken off first only where a sum would leave the range of floats.
    """
    with np.errstate(over="ignore"):
        shares = np.exp(logits)
    total = np.einsum("ij->i", shares)
    most = 0.0
    if not (total.min() > _LEAST_TOTAL and total.max() < np.inf):
        most = logits.max(axis=1)
        shares = np.exp(logits - most[:, None])
        total = np.einsum("ij->i", shares)
    return shares, total, np.log(total, dtype=np.float64) + most


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and the logarithm of each row's sum."""
    shares, total, log = _exponentials(logits)
    shares *= (1 / total)[:, None]
    return shares, log


def _sums(table: np.ndarray, rows: list[np.ndarray], constants: np.ndarray,
          of: np.ndarray | None = None) -> np.ndarray:
    """The rows of weights added up, with the constants or with the rows ``of`` these."""
    total = np.empty((len(rows[0]), table.shape[1]), table.dtype)
    more = np.empty_like(total)
    # "clip" writes straight to ``out``; no row lies outside its table.
    np.take(table, rows[0], axis=0, out=total, mode="clip")
    for row in rows[1:]:
        total += np.take(table, row, axis=0, out=more, mode="clip")
    total += constants if of is None else np.take(constants, of, axis=0, out=more, mode="clip")
    return total


def _blocks(table: np.ndarray, rows: list[np.ndarray], constants: np.ndarray,
            of: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray]]:
    """:func:`_sums` of a block of rows at a time."""
    for at in range(0, len(rows[0]), _BLOCK):
        part = slice(at, at + _BLOCK)
        yield part, _sums(table, [r[part] for r in rows], constants, None if of is None else of[part])


def _log_shares(own: np.ndarray, *logits) -> np.ndarray:
    """Natural log of the softmax of each row at its column ``own``; ``logits`` as of :func:`_blocks`."""
    out = np.empty(len(own))
    for part, block in _blocks(*logits):
        out[part] = block[np.arange(len(block)), own[part]] - _exponentials(block)[2]
    return out


def _class_rows(features: list[np.ndarray]) -> list[np.ndarray]:
    return [(f & np.uint64(CLASS_ROWS - 1)).astype(np.uint16) for f in features]


def _word_rows(features: list[np.ndarray], chosen: np.ndarray, label: np.ndarray,
               size: int = WORD_ROWS):
    shift = label.astype(np.uint64) * _KINDS[0]
    return [((W.mix(f[chosen] + shift)) & np.uint64(size - 1)).astype(np.uint16)
            for f in features]


def outside_scores(tokens: np.ndarray, features: list[np.ndarray], ranks: np.ndarray,
                   tree: Tree, weights: Weights) -> np.ndarray:
    """Natural log of each token's probability within the last class, without the unknown token;
    for a rare token that of its group, for one inside the model 0."""
    out = np.zeros(len(tokens))
    for at in range(0, len(tokens), _STEP):
        part = slice(at, at + _STEP)
        chosen, name, row, child = tree.steps(tokens[part], ranks[part])
        if len(chosen):
            rows = _word_rows([f[part] for f in features], chosen, name, TREE_ROWS)
            out[part] = np.bincount(chosen, _log_shares(
                child, weights.tree, rows, tree.constants, row), len(out[part]))
    return out


def _packed(lists: pa.ListArray, name: str) -> pa.BinaryArray:
    """A 64-bit field of each list's structs as bytes, which pass through joins faster than structs."""
    sizes = pc.list_value_length(lists).to_numpy(False)
    ends = np.concatenate(([0], np.cumsum(sizes) * 8)).astype(np.int32)
    values = np.ascontiguousarray(lists.flatten().field(name).to_numpy(), np.int64)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _unpacked_numbers(column: pa.BinaryArray) -> np.ndarray:
    """The numbers that :func:`_packed` put into all values; a missing value has none."""
    return np.frombuffer(b"".join(pc.fill_null(column, b"").to_pylist()), np.int64)


def _group_logits(batch: pa.RecordBatch, table: np.ndarray):
    """For rare tokens with their group's tokens and counts: the logits of these, the token's
    place among them or -1, its count or 0, and for each PER_CLASS places the tokens whose groups
    go so far with their rows of weights."""
    token = batch.column("token").to_numpy()
    packed = batch.column("member_tokens")
    sizes = pc.fill_null(pc.binary_length(packed), 0).to_numpy(False) // 8
    members, counts = _unpacked_numbers(packed), _unpacked_numbers(batch.column("member_counts"))
    owner = np.repeat(np.arange(len(token)), sizes)
    column = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = -(-max(int(sizes.max(initial=0)), 1) // PER_CLASS) * PER_CLASS
    logits = np.full((len(token), width), -1e9, np.float32)
    logits[owner, column] = np.log(counts + SMOOTHING)
    place, n = np.full(len(token), -1), np.zeros(len(token), np.int64)
    own = members == token[owner]
    place[owner[own]], n[owner[own]] = column[own], counts[own]
    features = [batch.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1", "f2")]
    group = batch.column("group").to_numpy()
    rows = []
    for chunk in range(width // PER_CLASS):
        places = slice(chunk * PER_CLASS, (chunk + 1) * PER_CLASS)
        which = np.flatnonzero(sizes > places.start) if chunk else np.arange(len(token))
        row = _word_rows(features, which, group[which] * (1 << 16) + chunk, GROUP_ROWS)
        logits[which, places] = _sums(table, row, logits[which, places])
        rows.append((which, places, row))
    return logits, place, n, rows


def token_scores(tokens: np.ndarray, starts: np.ndarray, numbers: np.ndarray, weights: Weights,
                 ) -> np.ndarray:
    """Natural log of each token's probability; for a token outside the model, of its class's."""
    out = np.empty(len(tokens))
    features = _features(tokens, starts)
    for at in range(0, len(tokens), _STEP):
        part = slice(at, at + _STEP)
        number = numbers[part]
        label = np.where(number > 0, 1 + (number - 1) // PER_CLASS, 0)
        parts = [f[part] for f in features]
        own = _log_shares(label, weights.classes, _class_rows(parts), weights.class_constants)
        inside = np.flatnonzero(number > 0)
        if len(inside):
            own[inside] += _log_shares(
                (number[inside] - 1) % PER_CLASS, weights.words,
                _word_rows(parts, inside, label[inside]), weights.word_constants, label[inside])
        out[part] = own
    return out


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of ``row`` ordered by value, where each value begins there, and how often it
    occurs.  The most frequent values stand first."""
    order = np.argsort(row, kind="stable")
    ordered = row[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.concatenate((first, [len(row)])))
    falling = np.argsort(np.minimum(sizes, _ADDED_APART).astype(np.uint8), kind="stable")[::-1]
    return order, first[falling], sizes[falling]


def _run_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray,
              sizes: np.ndarray) -> np.ndarray:
    """Sums of ``values[order]`` by run; the runs that go on always are the first ones."""
    total = np.take(values, order[first], axis=0, mode="clip")
    more = np.empty_like(total)
    going_on = np.cumsum(np.bincount(np.minimum(sizes, _ADDED_APART))[::-1])[::-1].tolist()
    for depth, left in enumerate(going_on[2:_ADDED_APART], 1):
        total[:left] += np.take(
            values, order[first[:left] + depth], axis=0, out=more[:left], mode="clip")
    for i in range(going_on[_ADDED_APART] if len(going_on) > _ADDED_APART else 0):
        rest = order[first[i] + _ADDED_APART - 1:first[i] + sizes[i]]
        total[i] += np.take(values, rest, axis=0, mode="clip").sum(axis=0)
    return total


class _Learner:
    """Gradient steps on one task's copy of a weight table."""

    def __init__(self, table: np.ndarray):
        self.table = table.copy()
        self.seen = np.zeros(len(table), np.float32)
        self.squares = np.ones(len(table), np.float32)
        self._room = np.empty((0, table.shape[1]), np.float32)

    def errors(self, own: np.ndarray, rows: list[np.ndarray], *constants) -> np.ndarray:
        """Probabilities less the truth, which is the column ``own``; valid until the next call."""
        if len(self._room) < len(own):
            self._room = np.empty((len(own), self.table.shape[1]), np.float32)
        error = self._room[:len(own)]
        for part, logits in _blocks(self.table, rows, *constants):
            shares, total, _ = _exponentials(logits)
            np.multiply(shares, (1 / total)[:, None], out=error[part])
        error[np.arange(len(own)), own] -= 1
        return error

    def step(self, rows: list[np.ndarray], error: np.ndarray) -> None:
        whole = np.dtype((np.void, self.table.strides[0]))  # a row of weights is written at once
        lines = self.table.view(whole)[:, 0]
        for row in rows:
            order, first, sizes = _runs(row)
            names = row[order[first]].astype(np.intp)
            self.seen[names] += sizes
            for at in range(0, len(names), _BLOCK):
                part = slice(at, at + _BLOCK)
                name = names[part]
                slope = _run_sums(error, order, first[part], sizes[part])
                squares = self.squares[name] + np.einsum("ij,ij->i", slope, slope) / slope.shape[1]
                self.squares[name] = squares
                slope *= (_RATE / np.sqrt(squares))[:, None]
                held = np.take(self.table, name, axis=0, mode="clip")
                held -= slope
                lines[name] = held.view(whole)[:, 0]


def _train(shared):
    """Task function: texts to this task's weights, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, tree, weights = _unpacked(shared)
        classes, words, nodes = (
            _Learner(t) for t in (weights.classes, weights.words, weights.tree))
        for batch in W.pieces(batches, "text"):
            tokens, bounds = token_hashes(batch.column("text"))
            ranks, _, numbers = lookup.find(tokens)
            features = _features(tokens, bounds[:-1])
            for at in range(0, len(tokens), _STEP):
                part = slice(at, at + _STEP)
                number = numbers[part]
                label = np.where(number > 0, 1 + (number - 1) // PER_CLASS, 0)
                parts = [f[part] for f in features]
                rows = _class_rows(parts)
                classes.step(rows, classes.errors(label, rows, weights.class_constants))
                inside = np.flatnonzero(number > 0)
                if len(inside):
                    rows = _word_rows(parts, inside, label[inside])
                    words.step(rows, words.errors(
                        (number[inside] - 1) % PER_CLASS, rows, weights.word_constants,
                        label[inside]))
                chosen, name, row, child = tree.steps(tokens[part], ranks[part])
                if len(chosen):
                    rows = _word_rows(parts, chosen, name, TREE_ROWS)
                    nodes.step(rows, nodes.errors(child, rows, tree.constants, row))
        yield from _learnt({0: classes, 1: words, 2: nodes})

    return run


def _learnt(learners: dict[int, _Learner]) -> Iterator[pa.RecordBatch]:
    """This task's weights in blocks of rows, without the blocks that it never updated."""
    task = TaskContext.get().partitionId()
    for kind, learner in learners.items():
        for block in range(0, len(learner.table), ROWS_PER_BLOCK):
            rows = slice(block, block + ROWS_PER_BLOCK)
            if learner.seen[rows].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], t) for c, t in (
                        (kind, pa.int32()), (block, pa.int32()), (task, pa.int32()),
                        (learner.seen[rows].tobytes(), pa.binary()),
                        (learner.table[rows].tobytes(), pa.binary()))],
                    ["kind", "block", "task", "seen", "weights"])


_OCCURRENCE = "group:bigint,token:bigint,f0:bigint,f1:bigint,f2:bigint,path:double"


def _occurrences(tree: Tree, tokens, features, at, path) -> pa.StructArray:
    """Rare tokens with the features of their context and the log of their group's probability."""
    columns = [tree.group(tokens[at]), tokens[at].view(np.int64),
               *(f[at].view(np.int64) for f in features), path[at]]
    return pa.StructArray.from_arrays(
        [pa.array(c) for c in columns], [c.split(":")[0] for c in _OCCURRENCE.split(",")])


def _rare(shared):
    """Task function: texts to the occurrences of rare tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, tree, _ = _unpacked(shared)
        for batch in W.pieces(batches, "text"):
            tokens, bounds = token_hashes(batch.column("text"))
            at = np.flatnonzero(lookup.find(tokens)[0] == 0)
            yield pa.RecordBatch.from_struct_array(_occurrences(
                tree, tokens, _features(tokens, bounds[:-1]), at, np.zeros(len(tokens))))

    return run


def _train_groups(shared):
    """Task function: rare tokens with their group's tokens to this task's weights of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = _Learner(_unpacked(shared)[2].groups)
        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                logits, place, _, rows = _group_logits(whole.slice(at, _STEP), learner.table)
                error, _ = _softmax(logits)
                error[np.arange(len(place)), place] -= 1
                for which, places, row in rows:
                    learner.step(row, np.ascontiguousarray(error[which, places]))
        yield from _learnt({3: learner})

    return run


def grouped(counts: Counts, tree: Tree) -> DataFrame:
    """(group, member_tokens, member_counts): the rare tokens of each group with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = tree.group(batch.column("token").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), *batch.columns], ["group", *batch.schema.names])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), _packed(members, "token"), _packed(members, "n")],
                ["group", "member_tokens", "member_counts"])

    return stored(counts.rare.select("token", "n").mapInArrow(
        run, "group bigint, token bigint, n bigint").groupBy("group").agg(
        F.sort_array(F.collect_list(F.struct("token", "n"))).alias("members")).mapInArrow(
        packed, "group bigint, member_tokens binary, member_counts binary"), "token-groups")


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the tasks' blocks to one average per block."""
    sums: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for kind, block, seen, found in zip(*(
                batch.column(c).to_pylist() for c in ("kind", "block", "seen", "weights"))):
            seen = np.frombuffer(seen, np.float32).astype(np.float64)
            found = np.frombuffer(found, np.float32).reshape(len(seen), -1)
            total = sums.setdefault((kind, block), [np.zeros(len(seen)), np.zeros(found.shape)])
            total[0] += seen
            total[1] += found * seen[:, None]
    for (kind, block), (seen, total) in sums.items():
        mean = (total / np.maximum(seen, 1)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind], pa.int32()), pa.array([block], pa.int32()),
             pa.array([mean.tobytes()], pa.binary())], ["kind", "block", "weights"])


_unpacked_last: dict[str, tuple] = {}


def _unpacked(shared) -> tuple[Lookup, Tree, Weights]:
    """The lookup, the tree and the weights of a broadcast, built once per worker process."""
    mark, hashes, counts, tree, weights = shared.value
    if mark not in _unpacked_last:
        _unpacked_last.clear()
        _unpacked_last[mark] = Lookup(hashes, counts), tree, weights
    return _unpacked_last[mark]


def train(
    training: DataFrame, counts: Counts, tree: Tree, groups: DataFrame, *, rounds: int = 1,
) -> tuple:
    """The trained model, ready to be broadcast, from all texts of ``training`` (text)."""
    ship(training.sparkSession)
    context = training.sparkSession.sparkContext
    weights = Weights.start(
        Lookup(counts.known, counts.known_counts).model_counts, counts.tokens)
    kinds = "kind int, block int, task int, seen binary, weights binary"
    for number in range(rounds if counts.tokens else 0):
        shared = context.broadcast(
            (f"{context.applicationId}-{id(counts)}-{number}", counts.known, counts.known_counts,
             tree, weights))
        tasks = -(-counts.tokens // TOKENS_PER_TRAINING_TASK)
        learnt = [training.select("text").coalesce(tasks).mapInArrow(_train(shared), kinds)]
        if tree.groups:
            rare = training.select("text").mapInArrow(
                _rare(shared), _OCCURRENCE.replace(":", " ").replace(",", ", "))
            learnt.append(rare.join(groups, "group").coalesce(tasks).mapInArrow(
                _train_groups(shared), kinds))
        weights = Weights(weights.classes.copy(), weights.words.copy(), weights.class_constants,
                          weights.word_constants, weights.tree.copy(), weights.groups.copy())
        for parts in learnt:
            means = parts.repartition("kind", "block").sortWithinPartitions(
                "kind", "block", "task").mapInArrow(
                _average, "kind int, block int, weights binary").collect()
            for row in means:
                table = (weights.classes, weights.words, weights.tree, weights.groups)[row["kind"]]
                found = np.frombuffer(row["weights"], np.float32).reshape(-1, table.shape[1])
                table[row["block"]:row["block"] + len(found)] = found
    return (f"{context.applicationId}-{id(counts)}-final", counts.known, counts.known_counts, tree,
            weights)


def _score(shared):
    """Task function: texts to what is known at once, and the tokens that need their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, tree, weights = _unpacked(shared)
        for batch in W.pieces(batches, "text"):
            tokens, bounds = token_hashes(batch.column("text"))
            ranks, logs, numbers = lookup.find(tokens)
            firsts = bounds[:-1]
            features = _features(tokens, firsts)
            hit = ranks > 0
            within = outside_scores(tokens, features, ranks, tree, weights)
            model = token_scores(tokens, firsts, numbers, weights) + np.where(hit, within, 0.0)
            missed = np.flatnonzero(~hit)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(missed, bounds).astype(np.int32)),
                _occurrences(tree, tokens, features, missed, within))
            sums = [np.add.reduceat(x, firsts) if len(firsts) else x for x in (
                hit.astype(np.int64), logs, model, (hit & (numbers == 0)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(bounds)),
                *map(pa.array, sums), lists,
            ], ["doc_id", "held_out", "n_tokens", "hits", "logs", "model", "outside", "missed"])

    return run


def _score_groups(shared):
    """Task function: rare tokens with their group's tokens to sums by text of the tokens known,
    of the logs of smoothed counts, and of the model's natural logs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unpacked(shared)[2].groups
        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                batch = whole.slice(at, _STEP)
                logits, place, n, _ = _group_logits(batch, table)
                own = logits[np.arange(len(place)), place].astype(np.float64)
                own += batch.column("path").to_numpy() - _softmax(logits)[1]
                known = place >= 0
                texts, row = np.unique(batch.column("row_id").to_numpy(), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts), *(pa.array(np.bincount(row, x, len(texts))) for x in (
                        known, np.log10(n + SMOOTHING), np.where(known, own, 0.0), ~known))],
                    ["row_id", "known", "logs", "model", "unknown"])

    return run


def score(docs: DataFrame, *, held_out: Column, rounds: int = 1) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), scored by what the rest of it teaches.

    Texts for which ``held_out`` does not hold are the training texts.  Tokens are
    runs of characters other than ASCII white space, A-Z lower-cased, and one end
    per text; a missing text has the end only.  Columns: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score (smoothed unigram) and score (the model), both
    base 10.  Without training texts only the unknown token has a probability.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.where("NOT held_out")
    counts = count_tokens(training)
    tree = Tree(counts.known_counts, counts.distinct - len(counts.known),
                counts.tokens - int(counts.known_counts.sum()))
    groups = grouped(counts, tree)
    shared = spark.sparkContext.broadcast(train(training, counts, tree, groups, rounds=rounds))
    inside = counts.known_counts[:tree.skipped]
    total = counts.tokens + SMOOTHING * (counts.distinct + 1)
    rest = counts.tokens - int(inside.sum()) + SMOOTHING * (counts.distinct + 1 - len(inside))
    # Of the last class the unknown token has a fixed share, and the tree all else.
    unknown = math.log(SMOOTHING / rest)
    others = math.log1p(-SMOOTHING / rest) if counts.distinct > len(inside) else 0.0

    rows = stored(docs.mapInArrow(
        _score(shared),
        "doc_id bigint, held_out boolean, n_tokens bigint, hits bigint, logs double, model double,"
        f" outside bigint, missed array<struct<{_OCCURRENCE}>>",
    ).withColumn("row_id", F.monotonically_increasing_id()), "scored")
    missed = rows.select("row_id", F.inline("missed")).join(groups, "group", "left")
    found = missed.mapInArrow(
        _score_groups(shared),
        "row_id bigint, known double, logs double, model double, unknown double",
    ).groupBy("row_id").agg(
        F.sum("known").cast("bigint").alias("more_known"), F.sum("logs").alias("more"),
        F.sum(F.col("model") + F.col("known") * F.lit(others)
              + F.col("unknown") * F.lit(unknown)).alias("more_model"))
    none = F.lit(0.0)
    return rows.drop("missed").join(found, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hits") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", none)
         - F.col("n_tokens") * F.lit(math.log10(total))).alias("base_score"),
        ((F.col("model") + F.col("outside") * F.lit(others) + F.coalesce("more_model", none))
         / F.lit(math.log(10))).alias("score"))
