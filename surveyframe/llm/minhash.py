"""Near duplicates by MinHash with tensored banding.

Two small collections of ``m`` keys are made from MinHash values; a table key is
a pair of one key from each.  ``m * m`` tables thus cost ``2 * m`` keys.  Two
texts meet in some table when some key of the first and some key of the second
collection agree.

Texts with the same shingle set are one class from the start.  In each table the
members of a bucket are compared with its least member.  Where a bucket then
still holds several components, each member outside the largest is compared with
all members of others, so that every pair that could still join two components
is verified, on full sets.  Small buckets list these pairs.  The members of large
ones are dealt to pairs of blocks, gathered by one key of the first collection
rather than by table; a task compares two blocks in one product of matrices and
reports a spanning forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.store import stored
from . import words as W
from .components import components
from .grouped import block_pairs, forest, groups
from .ship import ship

VALUES_PER_KEY = 2
MISS = 1e-4
MEMBERS_PER_TASK_GROUP = 512
LISTED_MEMBERS = 24
BLOCK_ROWS = 512
_COLUMNS_AT_ONCE = 4_096

_random = np.random.Generator(np.random.PCG64(7))
_FACTORS = _random.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(1, 1 << 63, 1024, dtype=np.uint64)


def keys_per_collection(similarity: float, values_per_key: int = VALUES_PER_KEY,
                        miss: float = MISS) -> int:
    """Keys each collection needs so that a pair at ``similarity`` misses all tables at most
    twice ``miss`` of the time."""
    agree = similarity ** values_per_key
    return max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def _shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    hashes, bounds = W.shingle_hashes(*W.word_hashes(texts), width)
    return [np.unique(hashes[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]


def _signatures(width: int, keys: int, values: int):
    """Task function: (doc_id, text) to set size, set fingerprint and the two collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            sets = _shingle_sets(batch.column("text"), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            marks = np.zeros((len(sets), 2), np.uint64)
            table = np.zeros((len(sets), 2 * keys), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                firsts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                for j in range(2):  # order-free: sums of two independent mixes
                    mixed = W.mix(flat * _FACTORS[1000 + j] + _TERMS[1000 + j])
                    marks[full, j] = W.mix(np.add.reduceat(mixed, firsts))
                for key in range(2 * keys):
                    total = np.zeros(len(full), np.uint64)
                    for v in range(values):
                        at = key * values + v
                        least = np.minimum.reduceat(flat * _FACTORS[at] + _TERMS[at], firsts)
                        total = W.mix(total ^ least)
                    table[full, key] = total
            lists = pa.FixedSizeListArray.from_arrays(
                pa.array(table.view(np.int64).ravel()), 2 * keys)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes),
                pa.array(marks[:, 0].view(np.int64)), pa.array(marks[:, 1].view(np.int64)),
                lists.cast(pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "mark1", "mark2", "keys"])

    return run


def _confirm(width: int, percent: int):
    """Task function: rows sorted by (a, salt, side) to the confirmed links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centres = None, []
        for batch in W.pieces(batches, "text"):
            left, right = [], []
            sets = _shingle_sets(batch.column("text"), width)
            places = zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "side", "id")))
            for found, (a, salt, side, other) in zip(sets, places):
                if (a, salt) != group:
                    group, centres = (a, salt), []
                if side == 0:
                    centres.append(found)
                elif any(_similar(centre, found, percent) for centre in centres):
                    left.append(a)
                    right.append(other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    if not len(one) or not len(other):
        return False
    if 100 * min(len(one), len(other)) < percent * max(len(one), len(other)):
        return False
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * shared >= percent * (len(one) + len(other) - shared)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; ``texts`` holds (id, text).

    The members of one ``a`` are dealt to groups of bounded size, each with the
    text of ``a`` before it, so that no task holds a hot group.
    """
    salts = pairs.groupBy("a").agg(
        F.ceil(F.count("*") / MEMBERS_PER_TASK_GROUP).alias("salts"))
    members = pairs.join(salts, "a").select(
        "a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.lit(1).alias("side"),
        F.col("b").alias("id"))
    centres = salts.select(
        "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"),
        F.lit(0).alias("side"), F.col("a").alias("id"))
    rows = members.union(centres).join(texts, "id").select("a", "salt", "side", "id", "text")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return stored(dealt.mapInArrow(_confirm(width, percent), "a bigint, b bigint"), "confirmed")


def near_duplicates(
    docs: DataFrame, *, width: int = 5, percent: int = 80,
    values_per_key: int = VALUES_PER_KEY, miss: float = MISS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    A text's set holds its distinct shingles of ``width`` words; with fewer words
    it is the whole sequence, and without words it is empty.  Texts are linked
    when ``100 * intersection >= percent * union``; empty sets link with nothing.
    ``component_id`` is the least doc_id reachable by links.

    A missing text has an empty set.  A row without doc_id takes no part: it has
    no component and is kept.  Rows that share a doc_id are one document: the
    links of each hold for all, and all are kept or none.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    keys = keys_per_collection(percent / 100, values_per_key, miss)
    marks = stored(docs.mapInArrow(
        _signatures(width, keys, values_per_key),
        "doc_id bigint, n_shingles bigint, mark1 bigint, mark2 bigint, keys array<bigint>"),
        "signatures")

    linkable = marks.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(linkable.groupBy("mark1", "mark2").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"),
        F.first("keys").alias("keys")), "classes")
    copies = linkable.select("doc_id", "mark1", "mark2").join(
        classes.select("mark1", "mark2", "id"), ["mark1", "mark2"]).where(
        "doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    # Keys are recomputed rather than written: they are the largest table of the job.
    first = classes.select("id", "n", "keys", F.posexplode(F.slice("keys", 1, keys)))
    table = first.select(
        "id", "n", F.xxhash64("pos", "col").alias("half"),
        F.posexplode(F.slice("keys", keys + 1, keys))).select(
        F.xxhash64("half", "pos", "col").alias("key"), "half", "id", "n")
    buckets = table.groupBy("key").agg(
        F.count("*").alias("members"), F.min("id").alias("least")).where("members > 1")
    shared = stored(table.join(buckets.select("key", "least"), "key"), "buckets")
    sizes = classes.select(F.col("id").alias("least"), F.col("n").alias("n_least")).distinct()

    near = (F.lit(100) * F.least("n", "n_other") >= F.lit(percent) * F.greatest("n", "n_other"))
    tried = stored(
        shared.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"),
                                           "n").distinct()
        .join(sizes.withColumnsRenamed({"least": "a", "n_least": "n_other"}), "a")
        .where(near).select("a", "b").distinct(), "pairs")
    wanted = shared.select("id").distinct()
    texts = stored(
        docs.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi"), "texts")
    links = _confirmed(tried, texts, width, percent)

    apart = _apart(shared, links)
    links = links.union(_confirmed(_listed(apart, tried, percent), texts, width, percent))
    links = links.union(_compared(apart, texts, width, percent))
    found = components(links.union(copies)).withColumnsRenamed({"id": "doc_id"})
    return marks.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _apart(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The buckets whose members are still in several components: (key, half, id, n, part, main,
    members), where ``main`` is the bucket's largest component."""
    parts = components(links).withColumnRenamed("component_id", "part")
    placed = stored(shared.join(parts, "id", "left").select(
        "key", "half", "id", "n", F.coalesce("part", "id").alias("part")), "parts")
    counts = placed.groupBy("key", "part").count()
    split = counts.groupBy("key").agg(
        F.count("*").alias("parts"), F.max_by("part", F.struct("count", "part")).alias("main"),
        F.sum("count").alias("members")).where("parts > 1").drop("parts")
    return stored(placed.join(split, "key"), "apart")


def _listed(apart: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Untried pairs of different components of small buckets."""
    small = apart.where(F.col("members") <= LISTED_MEMBERS)
    aside = small.where("part != main").select(
        "key", F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("part").alias("part_x"))
    pairs = small.join(aside, "key").where(
        (F.col("part") != F.col("part_x"))
        & ((F.col("part") == F.col("main")) | (F.col("id") < F.col("x")))
        & (F.lit(100) * F.least("n", "n_x") >= F.lit(percent) * F.greatest("n", "n_x"))
    ).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
    return stored(pairs.join(tried, ["a", "b"], "left_anti"), "pairs-apart")


def _compared(apart: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between different components of large buckets."""
    large = apart.where(F.col("members") > LISTED_MEMBERS).select("half", "id", "part").distinct()
    tasks = block_pairs(stored(large, "large"), "half", BLOCK_ROWS)
    sets = stored(texts.join(large.select("id").distinct(), "id", "left_semi").mapInArrow(
        _sets(width), "id bigint, shingles binary"), "sets")
    rows = tasks.join(sets, "id").select("task", "i", "j", "block", "id", "part", "shingles")
    dealt = rows.repartition("task").sortWithinPartitions("task")
    return stored(dealt.mapInArrow(_compare(percent), "a bigint, b bigint"), "compared")


def _sets(width: int):
    """Task function: texts to their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            sets = [s.tobytes() for s in _shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _compare(percent: int):
    """Task function: the two blocks of each task to a forest of the links between components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "task"):
            sets = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
            block = batch.column("block").to_numpy()
            part = batch.column("part").to_numpy()
            sizes = np.array([len(s) for s in sets])
            shared = _intersections(sets, sizes)
            linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
            linked &= part[:, None] != part[None, :]
            if batch.column("i")[0].as_py() != batch.column("j")[0].as_py():
                linked &= block[:, None] != block[None, :]
            has = np.flatnonzero(linked.any(axis=1))
            if len(has):
                ids = batch.column("id").to_numpy()[has]
                root = forest(linked[np.ix_(has, has)])
                joined = root != np.arange(len(has))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[joined]), pa.array(ids[root[joined]])], ["a", "b"])

    return run


def _intersections(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """How many values each two of some sets share."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    several = times[place] > 1
    owner, place = owner[several], place[several]
    names, place = np.unique(place, return_inverse=True)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(names), _COLUMNS_AT_ONCE):
        some = (place >= at) & (place < at + _COLUMNS_AT_ONCE)
        has = np.zeros((len(sets), min(_COLUMNS_AT_ONCE, len(names) - at)), np.float32)
        has[owner[some], place[some] - at] = 1
        shared += has @ has.T
    return np.rint(shared).astype(np.int64)
