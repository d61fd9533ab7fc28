"""Repeated byte strings of documents, by suffix arrays.

Every string of ``length`` bytes that also starts elsewhere is removed.  Sorting
all suffixes of a corpus would compare every place with every other, so places
are first dealt to shards in which all places that could match meet:

1. Each place has a landmark: the least hash among the spans of ``GRAM`` bytes
   inside its string, leftmost first.  Equal strings have equal landmarks at
   equal distance.  Consecutive places with one landmark are a run; its bytes are
   its piece.
2. Runs whose landmark's hash is alone in the corpus repeat nothing.  Runs with
   equal pieces repeat each other whole.  What is left are different pieces that
   share a landmark: one of each goes to a shard.
3. A shard is a bounded number of bytes, in the order of landmarks.  Its suffix
   array and common prefixes tell which places repeat.  A landmark that runs on
   into the next shard is merged with it: the places of one shard are looked up
   in the sorted places of the other by binary search.
4. Where more than ``GROUP_PIECES`` pieces share a landmark, their runs are cut by
   the distance to it, and the halves dealt by all bytes that their places have
   in common.  Pieces that differ there part; the cut is repeated until no group
   is too large, at the latest with one place a run, where a group is one string.

Pieces are told apart by the hashes of the landmark and of the piece, 64 bits
each; all other comparisons are of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.store import stored
from . import words as W
from .ship import ship
from .suffix_arrays import common_prefixes, leading_words, suffix_array

GRAM = 64
SHARD_BYTES = 1 << 20
GROUP_PIECES = 512
_SEGMENT = 4 << 20
_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from block-wise running minima."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.uint64(2**64 - 1))
    padded[:len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """The runs of some texts: text, first place in it, places, distance from the first place to
    the landmark, hash of the landmark, hash of the piece."""
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(data) < length:
        return none
    sums = W.rolling(data)
    every = np.arange(len(data) - gram + 1)
    grams = W.span_hash(sums, every, every + gram)
    marked = (grams & ~_PLACE) | every.astype(np.uint64)
    landmark = (_least_in_window(marked, length - gram + 1) & _PLACE).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:len(landmark)]
    places = np.flatnonzero(np.arange(len(landmark)) + length <= ends)
    if not len(places):
        return none
    landmark = landmark[places]
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) != 1) | (landmark[1:] != landmark[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(places)])))
    start, mark = places[first], landmark[first]
    # The place of the landmark is part of the piece's hash: a cut run must not pass for a whole.
    whole = data.tobytes()
    piece = W.digest(whole[a:b] for a, b in zip(
        start.tolist(), (start + count - 1 + length).tolist()))
    piece = W.mix(piece + (mark - start).astype(np.uint64))
    text = np.searchsorted(offsets, start, "right") - 1
    return [text, start - offsets[text], count, mark - start, grams[mark], piece]


RUNS = "did bigint, h bigint, start bigint, n int, distance int, mark bigint, piece bigint"


def _runs(length: int, gram: int):
    """Task function: (did, h, text) to runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            data, offsets = W.text_bytes(batch.column("text"))
            if len(data) <= 2 * _SEGMENT:
                yield rows(batch, runs_of(data, offsets, length, gram), 0)
                continue
            for at in range(0, max(1, len(data) - length + 1), _SEGMENT):  # one very long text
                part = data[at:at + _SEGMENT + length - 1]
                yield rows(batch, runs_of(part, np.array([0, len(part)]), length, gram), at)

    def rows(batch: pa.RecordBatch, found, at: int) -> pa.RecordBatch:
        text, start, n, distance, mark, piece = found
        text = pa.array(text)
        return pa.RecordBatch.from_arrays([
            batch.column("did").take(text), batch.column("h").take(text), pa.array(start + at),
            pa.array(n.astype(np.int32)), pa.array(distance.astype(np.int32)),
            pa.array(mark.view(np.int64)), pa.array(piece.view(np.int64)),
        ], [c.split()[0] for c in RUNS.split(", ")])

    return run


PIECES = ("mark bigint, key bigint, piece bigint, first int, n int, distance int, whole boolean,"
          " bytes binary")
_PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(),
                pa.binary()]


def _fetch(length: int):
    """Task function: texts with wanted pieces to the pieces' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a repeated row has the same key and the same text; one of them will do
        for batch in W.pieces(batches, "text"):
            out: list[tuple] = []
            for key, text, wanted in zip(
                    zip(batch.column("did").to_pylist(), batch.column("h").to_pylist()),
                    batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                if key in seen:
                    continue
                seen.add(key)
                data = (text or "").encode()
                for w in wanted:
                    out.append((w["mark"], w["mark"], w["piece"], 0, w["n"], w["distance"],
                                w["whole"], data[w["start"]:w["start"] + w["n"] - 1 + length]))
            yield _piece_rows(out)

    return run


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_PIECE_NAMES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES)], _PIECE_NAMES)


def _halves(level: int, length: int, gram: int):
    """Task function: pieces of large groups to the parts whose places lie in one range of distances
    to the landmark, with the hash of all that these places have in common as key."""
    size = -(-(length - gram + 1) // 2 ** level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks, parts = [], [], []
            for mark, _, piece, first, n, distance, whole, data in zip(
                    *(batch.column(c).to_pylist() for c in _PIECE_NAMES)):
                for number in range((distance - n + 1) // size, distance // size + 1):
                    # Places at distances from low to high; a higher distance is an earlier place.
                    low, high = max(number * size, distance - n + 1), min(
                        number * size + size - 1, distance)
                    at, count = distance - high, high - low + 1
                    rows.append((mark, 0, piece, first + at, count, high, whole,
                                 data[at:at + count - 1 + length]))
                    left = distance - number * size  # the last place of the full range
                    right = distance - (number * size + size - 1) + length
                    marks.append((mark, number, data[max(left, 0):right]))
                    parts.append(high)
            if not rows:
                continue
            keys = W.digest(m[2] for m in marks)
            keys = W.mix(keys + np.array([m[0] for m in marks], np.int64).view(np.uint64)
                         + np.array([m[1] for m in marks], np.uint64))
            made = _piece_rows([(r[0], int(k), *r[2:]) for r, k in zip(
                rows, keys.view(np.int64).tolist())])
            own = W.mix(W.digest(r[7] for r in rows) + np.array(parts, np.uint64))
            yield pa.RecordBatch.from_arrays(
                [*made.columns, pa.array(own.view(np.int64))], [*_PIECE_NAMES, "own"])

    return run


class _Shard:
    """Some pieces, their places in suffix order, and which of the places repeat."""

    def __init__(self, rows: list[tuple], length: int):
        self.rows, self.length = rows, length
        self.data = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
        sizes = np.array([len(r[7]) for r in rows])
        self.begins = np.cumsum(sizes) - sizes
        counts = np.array([r[4] for r in rows])
        is_place = np.zeros(len(self.data), bool)
        owner = np.repeat(np.arange(len(rows)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        is_place[self.begins[owner] + inner] = True
        words = leading_words(self.data)
        order = suffix_array(self.data, words)
        shared = common_prefixes(self.data, order, length, words)
        at = np.flatnonzero(is_place[order])
        # What two places share is the least of all steps between them.
        step = (np.minimum.reduceat(shared[:at[-1] + 1], at[:-1] + 1) if len(at) > 1
                else np.zeros(0, np.int64))
        same = step >= length
        self.order = order[at]
        self.repeated = np.zeros(len(self.data), bool)
        self.repeated[self.order[1:][same]] = True
        self.repeated[self.order[:-1][same]] = True

    def windows(self, places: np.ndarray) -> np.ndarray:
        """The strings at ``places`` as fixed-size values."""
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        return np.ascontiguousarray(view[places]).view(f"S{self.length}").ravel()

    def slice_of(self, key: int) -> tuple[int, int]:
        """The rows of a key, which stand together."""
        rows = [i for i, r in enumerate(self.rows) if r[1] == key]
        return rows[0], rows[-1] + 1

    def ordered_places(self, low: int, high: int) -> np.ndarray:
        """The places of rows ``low`` to ``high`` in suffix order."""
        start = self.begins[low]
        end = self.begins[high] if high < len(self.rows) else len(self.data)
        return self.order[(self.order >= start) & (self.order < end)]

    def found(self, row: int) -> list[int]:
        """Where the repeated places of a piece begin and end, in turn."""
        start, n = self.begins[row], self.rows[row][4]
        flags = np.concatenate(([0], self.repeated[start:start + n].astype(np.int8), [0]))
        return np.flatnonzero(np.diff(flags)).tolist()


def merge(one: _Shard, other: _Shard, key: int) -> None:
    """Mark the places of ``key`` that stand in both shards, by binary search of each sorted place
    of one in those of the other."""
    places = one.ordered_places(*one.slice_of(key))
    sought = other.ordered_places(*other.slice_of(key))
    sorted_windows = one.windows(places)
    for at in range(0, len(sought), 1 << 15):
        some = sought[at:at + (1 << 15)]
        windows = other.windows(some)
        low = np.searchsorted(sorted_windows, windows, "left")
        high = np.searchsorted(sorted_windows, windows, "right")
        other.repeated[some[high > low]] = True
        step = np.zeros(len(places) + 1, np.int64)
        np.add.at(step, low[high > low], 1)
        np.add.at(step, high[high > low], -1)
        one.repeated[places[np.cumsum(step[:-1]) > 0]] = True


def _repeats(length: int, shard_bytes: int):
    """Task function: pieces sorted by key to the ranges of places that repeat."""
    names = ["mark", "piece", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        running: list[_Shard] = []  # earlier shards that hold the last shard's last key
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _PIECE_NAMES)):
                rows.append(row)
                size += len(row[7])
                if size >= shard_bytes:
                    running, done = advance(running, rows)
                    yield from done
                    rows, size = [], 0
        if rows:
            running, done = advance(running, rows)
            yield from done
        if running:
            yield from report(running, running[-1].rows[-1][1], True)

    def advance(running: list[_Shard], rows: list[tuple]):
        """Sort one more shard; the shards of its last key stay open."""
        shard = _Shard(rows, length)
        done = []
        if running:
            key = running[-1].rows[-1][1]
            if rows[0][1] == key:
                for earlier in running:
                    merge(earlier, shard, key)
                if rows[-1][1] == key:  # nothing but the key
                    return [*running, shard], done
                done += report([*running, shard], key, True)
            else:
                done += report(running, key, True)
            closed = key
        else:
            closed = None
        last = rows[-1][1]
        done += report([shard], None, False, skip={closed, last})
        return [shard], done

    def report(shards: list[_Shard], key, only: bool, skip=frozenset()):
        out: list[tuple] = []
        for shard in shards:
            for i, row in enumerate(shard.rows):
                if (row[1] == key if only else row[1] not in skip) and not row[6]:
                    edges = shard.found(i)
                    out += [(row[0], row[2], row[3] + a, row[3] + b)
                            for a, b in zip(edges[::2], edges[1::2])]
        if not out:
            return []
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return [pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), types)], names)]

    return run


RANGES = "mark bigint, piece bigint, low int, high int"


def _keys() -> list[Column]:
    """A text's key: its id and a hash of both, so that repeated ids keep their texts apart."""
    return [F.coalesce(F.col("doc_id"), F.lit(0)).alias("did"),
            F.xxhash64("doc_id", "text").alias("h")]


def remove_repeats(
    docs: DataFrame, *, length: int = 400, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs`` (doc_id, text).

    A byte goes when a string of ``length`` bytes over it also starts anywhere
    else, in the same text or in another; all strings are judged on the input.
    ``kept`` is what is left, as bytes; ``n_spans`` counts the maximal removed runs.
    A missing text is empty.  Each row is a text of its own, also where ids
    repeat or are missing, so a repeated row repeats its text.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = docs.select(*_keys(), "text")
    runs = stored(texts.mapInArrow(_runs(length, gram), RUNS), "runs")

    shared = runs.groupBy("mark").count().where("count > 1").select("mark")
    runs = stored(runs.join(shared, "mark"), "shared-runs")
    pieces = stored(runs.groupBy("mark", "piece").agg(
        F.count("*").alias("copies"),
        F.min(F.struct("did", "h", "start", "n", "distance")).alias("r")), "pieces")
    groups = pieces.groupBy("mark").agg(F.count("*").alias("size"))
    wanted = pieces.join(groups.where("size > 1"), "mark").select(
        "r.did", "r.h", F.struct("mark", "piece", "r.start", "r.n", "r.distance",
                                 (F.col("copies") > 1).alias("whole")).alias("w"))
    wanted = wanted.groupBy("did", "h").agg(F.collect_list("w").alias("wanted"))
    bytes_of = stored(
        texts.join(wanted, ["did", "h"]).mapInArrow(_fetch(length), PIECES), "piece-bytes")

    ready, cut = [], []
    rest, level = bytes_of, 0
    while True:
        sizes = rest.groupBy("key").agg(F.count("*").alias("members"))
        large = sizes.where(F.col("members") > group_pieces).select("key")
        if large.isEmpty():
            ready.append(rest)
            break
        large = stored(large, "large-groups")
        ready.append(rest.join(large, "key", "left_anti").select(_PIECE_NAMES))
        level += 1
        halves = stored(rest.join(large, "key").select(_PIECE_NAMES).mapInArrow(
            _halves(level, length, gram), f"{PIECES}, own bigint"), "halves")
        equal = halves.groupBy("key", "own").agg(
            F.min(F.struct("mark", "piece", "first")).alias("one"),
            ((F.count("*") > 1) | F.max("whole")).alias("all"))
        placed = halves.join(equal, ["key", "own"])
        cut.append(placed.where("all AND NOT whole").select(
            "mark", "piece", F.col("first").alias("low"),
            (F.col("first") + F.col("n")).alias("high")))
        alone = equal.groupBy("key").count().where("count > 1").select("key")
        rest = stored(placed.where(F.col("one") == F.struct("mark", "piece", "first")).withColumn(
            "whole", F.col("all")).select(_PIECE_NAMES).join(alone, "key", "left_semi").select(
            _PIECE_NAMES), "rest")

    sorted_pieces = ready[0]
    for more in ready[1:]:
        sorted_pieces = sorted_pieces.union(more)
    ranges = sorted_pieces.repartition("key").sortWithinPartitions("key", "piece", "first").mapInArrow(
        _repeats(length, shard_bytes), RANGES)
    for more in cut:
        ranges = ranges.union(more)

    whole = runs.join(pieces.where("copies > 1").select("mark", "piece"), ["mark", "piece"]).select(
        "did", "h", "start", (F.col("start") + F.col("n") - 1 + length).alias("stop"))
    some = stored(ranges, "ranges").join(
        pieces.where("copies = 1").select("mark", "piece", "r"), ["mark", "piece"]).select(
        "r.did", "r.h", (F.col("r.start") + F.col("low")).alias("start"),
        (F.col("r.start") + F.col("high") - 1 + length).alias("stop"))
    # Equal rows share (did, h): a set holds each of their spans once.
    removed = whole.union(some).groupBy("did", "h").agg(
        F.collect_set(F.struct("start", "stop")).alias("removed"))
    keyed = docs.select(*_keys(), "doc_id", "text")
    return keyed.join(removed, ["did", "h"], "left").select(
        "doc_id", "text", "removed.start", "removed.stop").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: texts without the ranges that are removed."""
    for batch in W.pieces(batches, "text"):
        data, offsets = W.text_bytes(batch.column("text"))
        n_removed, n_spans, kept = [], [], []
        for row, (starts, stops) in enumerate(zip(batch.column("start"), batch.column("stop"))):
            text = data[offsets[row]:offsets[row + 1]]
            if not starts.is_valid:
                n_removed.append(0)
                n_spans.append(0)
                kept.append(text.tobytes())
                continue
            step = np.zeros(len(text) + 1, np.int64)
            np.add.at(step, starts.values.to_numpy(), 1)
            np.add.at(step, stops.values.to_numpy(), -1)
            gone = np.cumsum(step[:-1]) > 0
            n_removed.append(int(gone.sum()))
            n_spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            kept.append(text[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()),
            pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()),
        ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
