"""Fill-in-middle: each text is cut at two ranks and its parts are put in another order.

A text is an indexable skip list over its bytes.  A node holds up to 64 of them;
express lanes link ever fewer nodes, and each link carries how many units and how
many code points it passes over.  From the highest lane down, a search follows
links while the units passed stay within the wanted rank, so it reaches a cut in
logarithmic time, with its code points counted on the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .ship import ship

MARKERS = ("<P>", "<S>", "<M>")
NODE_BYTES = 64
LANE_BITS = 2  # a node of one lane is in the next one with probability 1/4
UNITS = ("code_point", "word", "line")


def unit_starts(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Marks the first byte of every unit; the first byte of a text begins one in any case.

    A word or a line runs up to the start of the next one.
    """
    if unit == "code_point":
        return (data & 0xC0) != 0x80
    marks = np.zeros(len(data), bool)
    marks[offsets[:-1][np.diff(offsets) > 0]] = True
    if unit == "line":
        marks[1:] |= data[:-1] == 10
        return marks
    starts, _, bounds = W.word_places(data, offsets, W.NOT_SPACE)
    first = np.zeros(len(starts), bool)  # space before the first word belongs to it
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    marks[starts[~first]] = True
    return marks


class SkipLists:
    """One skip list for each text of a batch; searches go through all lists at once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "code_point"):
        sizes = np.diff(offsets)
        counts = -(-sizes // NODE_BYTES)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # the first node of each text
        total = int(self.first[-1])
        self.text = np.repeat(np.arange(len(sizes)), counts)
        number = np.arange(total) - self.first[self.text]
        self.start = offsets[:-1][self.text] + NODE_BYTES * number
        self.end = np.minimum(self.start + NODE_BYTES, offsets[1:][self.text])
        self.offsets = offsets
        self.units = unit_starts(data, offsets, unit)
        self.chars = (data & 0xC0) != 0x80
        unit_widths, char_widths = (
            np.add.reduceat(marks, self.start, dtype=np.int64) if total else np.zeros(0, np.int64)
            for marks in (self.units, self.chars))
        passed = [np.concatenate(([0], np.cumsum(w))) for w in (unit_widths, char_widths)]
        self.n_units, self.n_chars = (p[self.first[1:]] - p[self.first[:-1]] for p in passed)

        # A node's height is the number of trailing zero digits of a hash of its number.
        digits = W.mix(number.astype(np.uint64) + np.uint64(1))
        height = np.zeros(total, np.int64)
        for lane in range(1, 32):
            height += (digits & np.uint64((1 << (LANE_BITS * lane)) - 1)) == 0
        height[number == 0] = 32  # every lane begins at the first node
        self.lanes: list[tuple[np.ndarray, ...]] = []
        members = np.arange(total)
        while True:
            ends = np.append(members[1:], total)
            same = np.append(self.text[members[1:]] == self.text[members[:-1]], False)
            # (nodes, units and code points a link passes, whether there is one, the place below)
            below = np.searchsorted(self.lanes[-1][0], members) if self.lanes else members
            self.lanes.append((
                members, *(np.where(same, p[ends] - p[members], 0) for p in passed), same, below))
            higher = members[height[members] >= len(self.lanes)]
            if len(higher) == len(members) or not same.any():
                break
            members = higher

    def find(self, texts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code points before it) at which the unit of each rank begins; behind the last
        unit that is the end of the text."""
        byte = self.offsets[texts].copy()
        chars = np.zeros(len(texts), np.int64)
        some = np.flatnonzero(self.first[texts] < self.first[texts + 1])
        if not len(some):
            return byte, chars
        left = ranks[some].astype(np.int64)
        passed = np.zeros(len(some), np.int64)
        place = np.searchsorted(self.lanes[-1][0], self.first[texts[some]])
        for lane in range(len(self.lanes) - 1, -1, -1):
            _, units, points, linked, below = self.lanes[lane]
            moving = np.arange(len(some))
            while len(moving):
                at = place[moving]
                moving = moving[linked[at] & (units[at] <= left[moving])]
                at = place[moving]
                left[moving] -= units[at]
                passed[moving] += points[at]
                place[moving] = at + 1
            place = below[place]
        # Inside the node: the unit with that many before it, or the node's end.
        column = np.arange(NODE_BYTES)
        here = self.start[place][:, None] + column
        inside = here < self.end[place][:, None]
        here = np.minimum(here, len(self.units) - 1)
        before = np.cumsum(self.units[here] & inside, axis=1) > left[:, None]
        stop = np.where(before.any(axis=1), before.argmax(axis=1), self.end[place] - self.start[place])
        byte[some] = self.start[place] + stop
        chars[some] = passed + (self.chars[here] & inside & (column < stop[:, None])).sum(axis=1)
        return byte, chars


NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
ARROW = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def _transform(unit: str, fim_percent: int, spm_percent: int, markers: Sequence[str]):
    prefix, suffix, middle = (m.encode() for m in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            data, offsets = W.text_bytes(batch.column("text"))
            lists = SkipLists(data, offsets, unit)
            first, second, shape, order = (
                batch.column(f"__h{i}").to_numpy().astype(np.int64) for i in range(1, 5))
            ends = lists.n_units + 1
            ranks = np.sort(np.stack([first % ends, second % ends]), axis=0)
            rows = np.arange(batch.num_rows)
            cut, cut_chars = lists.find(rows, ranks[0])
            end, end_chars = lists.find(rows, ranks[1])
            plain = (np.diff(offsets) == 0) | (shape % 100 >= fim_percent)
            spm = order % 100 < spm_percent
            outputs, forms = [], []
            for row in range(batch.num_rows):
                text = data[offsets[row]:offsets[row + 1]].tobytes()
                if not plain[row] and any(m in text for m in (prefix, suffix, middle)):
                    plain[row] = True
                if plain[row]:
                    outputs.append(text)
                    forms.append("plain")
                    continue
                a, b = int(cut[row] - offsets[row]), int(end[row] - offsets[row])
                parts = (prefix + text[:a], suffix + text[b:])
                outputs.append(b"".join((*(reversed(parts) if spm[row] else parts), middle, text[a:b])))
                forms.append("spm" if spm[row] else "psm")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(lists.n_units), pa.array(forms, pa.string()),
                pa.array(cut_chars, mask=plain), pa.array(end_chars - cut_chars, mask=plain),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ], list(NAMES))

    return run


def transform(
    docs: DataFrame, *, seed: int = 1, unit: str = "code_point", fim_percent: int = 90,
    spm_percent: int = 20, markers: Sequence[str] = MARKERS,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs`` (doc_id, text).

    ``n`` counts the text's units: code points, words or lines.  The first four groups of
    eight digits of the sha256 of ``seed:doc_id`` choose the two cuts (each modulo n + 1), whether
    the text is cut at all (in ``fim_percent`` of 100) and whether its suffix comes first (in
    ``spm_percent`` of 100).  ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix,
    middle), or plain: the text as it is.  A text that is missing, empty or holds a marker is plain,
    and a missing one empty.  A row without doc_id is cut as if its id were an empty string; rows
    that share an id are cut at the same remainders, each in its own text.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {', '.join(UNITS)}")
    if len(set(markers)) != 3 or not all(
            re.fullmatch(r"<[^<>]+>", m) for m in markers):
        raise ValueError("markers are three different names in angle brackets")
    ship(docs.sparkSession)
    digest = F.sha2(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", digest.alias("__d"))
    rows = rows.select("doc_id", "text", *[
        F.conv(F.substring("__d", 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"__h{i + 1}")
        for i in range(4)])
    return rows.mapInArrow(
        _transform(unit, fim_percent, spm_percent, tuple(markers)),
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint,"
        " output string")


def restored(output: str, form: str, markers: Sequence[str] = MARKERS) -> Column:
    """The text that ``output`` was made from: its parts between the markers, in their first order.

    No part holds a marker, and none can arise where a part meets one, as both brackets stand
    only at a marker's ends.
    """
    parts = F.split(F.col(output), "|".join(re.escape(m) for m in markers), -1)
    one, two, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (F.when(F.col(form) == "psm", F.concat(one, middle, two))
            .when(F.col(form) == "spm", F.concat(two, middle, one)).otherwise(F.col(output)))
