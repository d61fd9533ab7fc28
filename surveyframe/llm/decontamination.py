"""Benchmark items inside documents, by size-partitioned MinHash containment search.

A short item inside a long document has a Jaccard similarity near zero, so equal
minima of whole documents find nothing.  The sketch is taken of the items only:
an item's bottom-k sketch holds its ``k`` least shingle hashes, and a document is
screened for every one of them.  Items are partitioned by size.  Within a
partition ``k`` is one more than the shingles that the largest item may lack at
the wanted containment, so an item that is contained has a sketch hash in the
document without fail, and a document with too few words skips the partition.
Candidates are verified on the words themselves.

The items are a query set that is compared with all documents in blocks of
bounded size; one block is held by every task, and each block reads the
documents once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import words as W
from .ship import ship

BLOCK_BYTES = 32 << 20
_FILTER_BITS = 22
_WORD = re.compile("[^\x00-/:-`{-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _runs(text: str, width: int) -> set[tuple[str, ...]]:
    found = _WORD.findall(text.translate(_LOWER))
    return {tuple(found[i:i + width]) for i in range(len(found) - width + 1)}


def _item_runs(text: str, width: int) -> set[tuple[str, ...]]:
    """The runs of an item; one of fewer words than ``width`` is a run of its own."""
    found = tuple(_WORD.findall(text.translate(_LOWER)))
    return {found} if 0 < len(found) < width else _runs(text, width)


class Screen:
    """The sketches of one block of items, and what verifies a candidate."""

    def __init__(self, items: list[tuple[int | None, str]], width: int, percent: int):
        self.width, self.percent = width, percent
        self.names = [item for item, _ in items]
        self.sets = [_item_runs(text, width) for _, text in items]
        # Items shorter than the width, by their number of words: each is one run, found exactly.
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for i, found in enumerate(self.sets):
            for run in found:
                if len(run) < width:
                    self.short.setdefault(len(run), {}).setdefault(run, []).append(i)
        self.short_hashes = {
            size: np.sort(W.shingle_hashes(*W.word_hashes(
                pa.array([" ".join(run) for run in runs], pa.string()), W.LETTER_OR_DIGIT),
                size, short=False)[0])
            for size, runs in self.short.items()}
        hashes, bounds = W.shingle_hashes(
            *W.word_hashes(pa.array([t for _, t in items], pa.string()), W.LETTER_OR_DIGIT),
            width, short=False)
        by_size = defaultdict(list)
        for i, found in enumerate(self.sets):
            if found and len(next(iter(found))) == width:
                by_size[len(found).bit_length()].append(i)
        self.least_size = []  # of each partition: shingles that a document needs
        sketch, owner, part = [], [], []
        for number, members in enumerate(by_size.values()):
            sizes = [len(self.sets[i]) for i in members]
            k = max(sizes) * (100 - percent) // 100 + 1
            self.least_size.append(-(-min(sizes) * percent // 100))
            for i in members:
                least = np.unique(hashes[bounds[i]:bounds[i + 1]])[:k]
                sketch.append(least)
                owner.append(np.full(len(least), i))
                part.append(np.full(len(least), number))
        self.sketch = np.concatenate(sketch) if sketch else np.zeros(0, np.uint64)
        order = np.argsort(self.sketch, kind="stable")
        self.sketch = self.sketch[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)
        self.part = np.concatenate(part)[order] if part else np.zeros(0, np.int64)
        self.least_size = np.array(self.least_size, np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.sketch >> np.uint64(64 - _FILTER_BITS)] = True

    def candidates(self, texts: pa.Array) -> list[tuple[int, int]]:
        """(row, item) pairs that share a hash of the item's sketch."""
        return self._candidates(*W.word_hashes(texts, W.LETTER_OR_DIGIT))

    def short_rows(self, words: np.ndarray, text_bounds: np.ndarray) -> dict[int, set[int]]:
        """For each row that holds the hash of a short item, the numbers of words of such items."""
        out: dict[int, set[int]] = {}
        for size, wanted in self.short_hashes.items():
            hashes, bounds = W.shingle_hashes(words, text_bounds, size, short=False)
            place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            at = np.flatnonzero(wanted[place] == hashes)
            for row in np.unique(np.searchsorted(bounds, at, "right") - 1).tolist():
                out.setdefault(row, set()).add(size)
        return out

    def _candidates(self, words: np.ndarray, text_bounds: np.ndarray) -> list[tuple[int, int]]:
        hashes, bounds = W.shingle_hashes(words, text_bounds, self.width, short=False)
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        low = np.searchsorted(self.sketch, hashes[at], "left")
        high = np.searchsorted(self.sketch, hashes[at], "right")
        at, low, count = at[high > low], low[high > low], (high - low)[high > low]
        rows = np.repeat(np.searchsorted(bounds, at, "right") - 1, count)
        place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        enough = np.diff(bounds)[rows] >= self.least_size[self.part[place]]
        pairs = np.unique(np.stack([rows[enough], self.owner[place[enough]]], 1), axis=0)
        return [tuple(p) for p in pairs.tolist()]

    def verified(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shingles of the item in the text) where containment holds."""
        words, text_bounds = W.word_hashes(texts, W.LETTER_OR_DIGIT)
        for found, sizes in self.short_rows(words, text_bounds).items():
            for size in sizes:
                runs = self.short[size]
                for run in runs.keys() & _runs(texts[found].as_py(), size):
                    for item in runs[run]:
                        yield found, item, 1
        row, inside = None, set()
        for found, item in self._candidates(words, text_bounds):
            if found != row:
                row, inside = found, _runs(texts[found].as_py(), self.width)
            shared = len(self.sets[item] & inside)
            if 100 * shared >= self.percent * len(self.sets[item]):
                yield row, item, shared


def _screens(items: DataFrame, width: int, percent: int, block_bytes: int) -> Iterator:
    """A broadcast screen for each block of the items."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(
        "text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    for number in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        rows = [tuple(r) for r in block.orderBy("item_id", "text").collect()]
        yield items.sparkSession.sparkContext.broadcast(Screen(rows, width, percent))


def contained_items(
    docs: DataFrame, items: DataFrame, *, width: int = 5, percent: int = 80,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): the items (item_id, text) of which
    at least ``percent`` of the distinct shingles stand in a document (doc_id, text).

    Words are runs of ASCII letters, digits and other letters, A-Z lower-cased.
    An item of fewer than ``width`` words is one shingle, its whole sequence, and is
    found where that stands in a document.  Missing texts and texts without words have
    no shingles: nothing is found.  Each row is a document and an item of its own,
    also where ids repeat or are missing; repeated item rows count once.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    names = ["doc_id", "item_id", "n_shingles", "n_found"]
    schema = ", ".join(f"{n} bigint" for n in names)

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            screen = shared.value
            for batch in W.pieces(batches, "text"):
                found = [
                    (batch.column("doc_id")[row].as_py(), screen.names[item],
                     len(screen.sets[item]), shared_count)
                    for row, item, shared_count in screen.verified(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 4)], names)
        return run

    found = spark.createDataFrame([], schema)
    for shared in _screens(items, width, percent, block_bytes):
        found = found.union(docs.mapInArrow(search(shared), schema))
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def without_contained(
    docs: DataFrame, items: DataFrame, *, width: int = 5, percent: int = 80,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item is contained
    (see :func:`contained_items`); rows without text stay."""
    ship(docs.sparkSession)

    def drop(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            screen = shared.value
            for batch in W.pieces(batches, "text"):
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _, _ in screen.verified(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))
        return run

    schema = T.StructType(docs.schema.fields)
    for shared in _screens(items, width, percent, block_bytes):
        docs = docs.mapInArrow(drop(shared), schema)
    return docs
