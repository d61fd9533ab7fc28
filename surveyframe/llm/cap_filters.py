"""Embedding near duplicates by spherical-cap filters.

The filters are the directions of a random product code: a direction is made of
one random unit vector for each block of coordinates, after a random rotation.
A vector is decoded to the list of all filters whose direction it exceeds by a
threshold, lowered where the list would be short; sums over the first and the
last blocks, one of them sorted, find them without trying the others.  Vectors that share a filter are
compared by their cosine.  A pair that shares several filters counts in the
least of them, which every task can tell from the vectors' lists.

Equal vectors are one from the start.  A filter with many vectors is dealt to
pairs of blocks of bounded size; each task reports sums and a spanning forest
of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..plans.store import stored
from .components import components
from .grouped import block_pairs, forest, groups
from .ship import ship

BLOCKS = 2
CODEWORDS = 256
# With few coordinates blocks would miss most directions: one block then, of more code words.
FEW_DIMENSIONS = 12
SINGLE_CODEWORDS = 4_096
THRESHOLD = 3.5  # in standard deviations of a random unit vector's coordinate
LEAST_FILTERS = 24
BLOCK_ROWS = 1_024


@lru_cache(maxsize=8)
def _code(dim: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation, and the unit code words of each block of coordinates."""
    rng = np.random.Generator(np.random.PCG64([dim, 93]))
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    few = dim < FEW_DIMENSIONS
    blocks = []
    for part in np.array_split(np.arange(dim), 1 if few else BLOCKS):
        words = rng.standard_normal((SINGLE_CODEWORDS if few else CODEWORDS, len(part)))
        blocks.append(words / np.linalg.norm(words, axis=1, keepdims=True))
    return rotation, blocks


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def filters_of(vectors: np.ndarray) -> list[np.ndarray]:
    """The numbers of the filters that each unit vector exceeds; at least the nearest few."""
    rotation, blocks = _code(vectors.shape[1])
    turned = vectors @ rotation
    edges = np.cumsum([0, *(b.shape[1] for b in blocks)])
    parts = [turned[:, a:b] @ w.T / np.sqrt(len(blocks))
             for a, b, w in zip(edges[:-1], edges[1:], blocks)]
    half = (len(parts) + 1) // 2

    def sums(some: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((len(vectors), 1))
        for part in some:
            total = (total[:, :, None] + part[:, None, :]).reshape(len(vectors), -1)
        return total

    left, right = sums(parts[:half]), sums(parts[half:])
    width = right.shape[1]
    order = np.argsort(-right, axis=1, kind="stable")
    falling = np.take_along_axis(right, order, 1)
    out = []
    for row in range(len(vectors)):
        threshold = min(0.9, THRESHOLD / np.sqrt(vectors.shape[1]))
        while True:
            wanted = threshold - left[row]
            some = np.flatnonzero(wanted <= falling[row, 0])
            count = np.searchsorted(-falling[row], -wanted[some], "right")
            if count.sum() >= LEAST_FILTERS:
                break
            threshold = 0.95 * threshold if threshold > 0.01 else threshold - 0.1
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out.append(np.sort(np.repeat(some, count) * width + order[row, place]))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: vectors with the list of their filters."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        filters: list = [None] * batch.num_rows
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            for some in np.array_split(rows, -(-len(rows) // 2_048)):
                vectors = _matrix(batch.column("embedding").take(pa.array(some)))
                for row, found in zip(some.tolist(), filters_of(unit(vectors))):
                    filters[row] = found
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(filters, pa.list_(pa.int32()))],
            [*batch.schema.names, "filters"])


def _links(similarity: float):
    """Task function: rows sorted by task group to link sums and a forest of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in groups(batches, "task"):
            found = group(batch)
            if found:
                waiting.append(found)
            if len(waiting) >= 500:
                yield rows(waiting)
                waiting = []
        if waiting:
            yield rows(waiting)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c)) for c in zip(*found)], ["id", "n", "root"])

    def group(batch: pa.RecordBatch):
        if batch.num_rows < 2:
            return None
        ids, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
        vectors = unit(_matrix(batch.column("embedding")))
        near = vectors @ vectors.T >= similarity
        one, other = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
        if one != other:  # two blocks: only across them
            side = batch.column("block").to_numpy()
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        linked = np.flatnonzero(near.any(axis=1))
        if not len(linked):
            return None
        near = near[np.ix_(linked, linked)]
        near &= ~_met_before(batch, linked)
        linked, near = linked[near.any(axis=1)], near[near.any(axis=1)][:, near.any(axis=1)]
        if not len(linked):
            return None
        ids, copies = ids[linked], copies[linked]
        order = np.argsort(ids, kind="stable")
        ids, copies, near = ids[order], copies[order], near[np.ix_(order, order)]
        root = forest(near)
        return ids, near @ copies, ids[root]

    return run


def _met_before(batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    """Which pairs of ``rows`` share a filter below the group's."""
    lists = batch.column("filters").take(pa.array(rows))
    values = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
    below = values < batch.column("filter")[0].as_py()
    names, place = np.unique(values[below], return_inverse=True)
    owner = owner[below]
    met = np.zeros((len(rows), len(rows)), bool)
    for at in range(0, len(names), 4_096):
        part = (place >= at) & (place < at + 4_096)
        has = np.zeros((len(rows), min(4_096, len(names) - at)), np.float32)
        has[owner[part], place[part] - at] = 1
        met |= has @ has.T > 0
    return met


def linked_vectors(vectors: DataFrame, *, similarity: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding,
    label).

    Rows with the same label are linked when their cosine, in double precision, is
    ``similarity`` or more; a missing label links with nothing.  So do vectors that
    are missing, empty or zero or hold missing or infinite components, and vectors
    of another length.  Equal vectors link with each other, repeated rows too.  A
    row without vec_id takes no part, has no component and is kept.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite
        & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = vectors.where(usable)
    classes = stored(
        good.groupBy("label", "embedding").agg(
            F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn(
            "dim", F.size("embedding")), "vectors")
    decoded = stored(classes.mapInArrow(
        _decode, T.StructType([*classes.schema, T.StructField(
            "filters", T.ArrayType(T.IntegerType()))])), "decoded")

    keys = decoded.select(
        F.xxhash64("label", "dim").alias("group"), "id", F.explode("filters").alias("filter"))
    keys = keys.withColumn("key", F.xxhash64("group", "filter"))
    tasks = block_pairs(keys, "key", BLOCK_ROWS)
    payload = decoded.select(
        F.xxhash64("label", "dim").alias("group"), "id", "copies", "embedding", "filters")
    rows = tasks.join(payload, ["group", "id"]).select(
        "task", "i", "j", "block", "filter", "id", "copies", "embedding", "filters")
    dealt = rows.repartition("task").sortWithinPartitions("task")
    found = stored(dealt.mapInArrow(
        _links(similarity), "id bigint, n bigint, root bigint"), "vector-links")

    sums = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    placed = classes.select(
        F.col("label").alias("__label"), F.col("embedding").alias("__embedding"), "id", "copies")
    placed = placed.join(sums, "id", "left").join(groups, "id", "left").select(
        "__label", "__embedding",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    key = F.when(usable, F.col("embedding"))
    answer = vectors.withColumn("__key", key).join(
        placed, (F.col("label") == F.col("__label")) & (F.col("__key") == F.col("__embedding")),
        "left")
    return answer.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
