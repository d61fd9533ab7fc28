"""Groups of rows that follow each other, and groups too large for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Each run of equal numbers in ``column`` as one batch, from batches sorted by it."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        if len(held) == 1:
            return held[0]
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        marks = batch.column(column).to_numpy()
        edges = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:]):
            if held and held[-1].column(column)[-1].as_py() != marks[low]:
                yield whole()
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield whole()


def block_pairs(rows: DataFrame, by: str, rows_per_block: int) -> DataFrame:
    """``rows`` (``by``, id, ...) dealt to tasks so that all rows of a group meet pairwise.

    A group is cut into blocks of about ``rows_per_block`` rows; there is a task
    for every pair of blocks.  Adds ``block``, ``i`` and ``j`` (the task's blocks)
    and ``task`` (its number); groups of one row are left out.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("__n")).where("__n > 1").select(
        by, F.ceil(F.col("__n") / rows_per_block).alias("__blocks"))
    dealt = rows.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("id"), "__blocks"))
    dealt = dealt.withColumn("__mate", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("__blocks") - 1)))
    return dealt.withColumns({
        "i": F.least("block", "__mate"), "j": F.greatest("block", "__mate"),
    }).withColumn("task", F.xxhash64(by, "i", "j")).drop("__blocks", "__mate")


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links, the least row that it can reach."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
        least = least[least]
        if (least == root).all():
            return root
        root = least
