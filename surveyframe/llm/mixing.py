"""Sources mixed to target weights by a multivariate-hypergeometric splitting tree.

A document is cut into blocks of consecutive words.  Each source's target is
met by whole passes over its blocks and a last pass over part of them, in an
order fixed by a hash.  The blocks so drawn are the source's quota.  A binary
tree over the output shards splits all quotas: a node's draws are dealt to its
two children by the multivariate hypergeometric distribution, as if all blocks
were shuffled, while every source's quota stays exact.  Each shard thus owns a
range of each source's permuted blocks; it takes these and shuffles them.

The tree is walked from the root to one leaf by the task of each shard, with
random numbers that depend on the node alone, so nothing is handed down.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..plans.store import stored
from . import words as W
from .ship import ship

BLOCK_WORDS = 512
BLOCKS_PER_SHARD = 8_192
BLOCKS_PER_SLICE = 2_048
MAX_SOURCES = 100_000
_MOST_AT_ONCE = 500_000_000


def count_words(text: str) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


@dataclass
class Mix:
    """``rows``: the documents with row_id, size and source_no; ``sources``: their sizes and
    targets; ``draws``: (shard, position, row_id, block, copy, words, source_no)."""

    rows: DataFrame
    sources: DataFrame
    draws: DataFrame
    block_words: int


def targets(rows: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """(source, source_no, source_size, target) of the sources of ``rows`` (source, size).

    Sources in code-point order, a missing one last, take ``weights`` in turn and
    share ``share`` of all words; none gets more than ``limit`` times its words,
    and the rest goes to the others by weight.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "source_no", F.row_number().over(order) - 1)
    sized = sized.withColumns({
        "weight": F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")),
        "most": F.col("source_size") * F.lit(float(limit)),
        "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
    })
    # By rising limit per weight, the first source that the others' rest does not fill ends the
    # capped ones.
    rising = everything.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0.0))
    after = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    sized = sized.withColumn("level", (F.col("budget") - before) / after)
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"),
                              F.struct(F.col("most") / F.col("weight"), "source_no", "level"))
                       ).over(everything)["level"]
    return sized.select(
        "source", "source_no", "source_size",
        F.least("most", F.coalesce(open_level * F.col("weight"), F.col("most"))).alias("target"))


def _order(seed: int, *parts: str | Column) -> Column:
    """A hash as text: equal everywhere, and evenly spread."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def mix(
    docs: DataFrame, *, share: float = 1.5, weights: Sequence[float] = (3, 1, 2),
    limit: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 0,
    blocks_per_shard: int = BLOCKS_PER_SHARD, keep: Sequence[str] = (),
) -> Mix:
    """Mix ``docs`` (doc_id, text, source); ``rows`` keeps the columns named in ``keep`` too.

    Each source's drawn words differ from its target by half a block at most, and
    no block is drawn more often than ``limit`` rounded up.  A missing text has no
    words and is not drawn; a missing source is a source of its own.  Rows that
    share a doc_id are drawn each for itself; the seed and the ids fix the result.
    The driver holds a quota for each source: more than MAX_SOURCES that are drawn
    stop the job with an error.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint"), "source",
        count_words("text").alias("size"), *[F.col(c) for c in keep if c not in (
            "doc_id", "source")]), "mixed-rows")
    sources = stored(targets(rows.select("source", "size"), weights, share, limit), "sources")
    passes = sources.withColumn("passes", F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    passes = passes.select(F.col("source").alias("__source"), "source_no", "passes", (
        F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))
    numbered = rows.select("row_id", "doc_id", "source", "size").join(
        passes, F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")

    count = F.ceil(F.col("size") / block_words)
    blocks = numbered.where("size > 0").select(
        "row_id", "doc_id", "source_no", "passes", "rest", "size",
        F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("block")).withColumns({
            "words": F.least(F.lit(block_words).cast("bigint"),
                             F.col("size") - F.col("block") * block_words),
            "hash": _order(seed, F.lit("pass"), "doc_id", "block")})
    total = blocks.count()
    digits = 1
    while 16 ** digits * BLOCKS_PER_SLICE < total:
        digits += 1

    # The last pass: slices of the hash order below the target are taken whole, and the one that
    # holds the target block by block.
    blocks = blocks.withColumn("slice", F.substring("hash", 1, digits))
    slices = blocks.groupBy("source_no", "slice").agg(F.sum("words").alias("slice_words"))
    below = Window.partitionBy("source_no").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1)
    slices = slices.withColumn("below", F.coalesce(F.sum("slice_words").over(below), F.lit(0)))
    placed = blocks.join(slices, ["source_no", "slice"])
    inside = (F.col("below") < F.col("rest")) & (
        F.col("below") + F.col("slice_words") > F.col("rest"))
    whole = placed.where(~inside).withColumn(
        "extra", (F.col("below") < F.col("rest")).cast("int"))
    within = Window.partitionBy("source_no", "slice").orderBy("hash", "row_id").rowsBetween(
        Window.unboundedPreceding, 0)
    part = placed.where(inside).withColumn("extra", (
        F.col("below") + F.sum("words").over(within) - F.col("words") / 2 <= F.col("rest")
    ).cast("int"))
    columns = ["row_id", "doc_id", "source_no", "block", "words", "passes", "extra"]
    drawn = whole.select(columns).union(part.select(columns)).select(
        "row_id", "doc_id", "source_no", "block", "words",
        F.explode(F.expr("filter(sequence(0L, passes + extra), x -> x > 0)")).alias("copy"))
    drawn = stored(drawn.withColumn(
        "hash", _order(seed, F.lit("draw"), "copy", "doc_id", "block")).withColumn(
        "slice", F.substring("hash", 1, digits)), "draws")

    # Places in each source's permuted order, and the ranges that the shards own.
    slices = drawn.groupBy("source_no", "slice").count()
    slices = stored(slices.withColumn("before", F.coalesce(
        F.sum("count").over(below), F.lit(0))), "slices")
    quotas = {r[0]: r[1] for r in slices.groupBy("source_no").agg(F.sum("count")).limit(
        MAX_SOURCES + 1).collect()}
    if len(quotas) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    n = sum(quotas.values())
    shards = max(1, -(-n // blocks_per_shard))
    cell = max(1, n // shards)
    rank = F.row_number().over(Window.partitionBy("source_no", "slice").orderBy("hash", "row_id"))
    ranked = drawn.join(slices.select("source_no", "slice", "before"), ["source_no", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + rank - 1).withColumn(
        "cell", F.floor(F.col("rank") / cell))
    owned = spark.range(shards).mapInPandas(
        _leaves(sorted(quotas.items()), shards, seed),
        "shard bigint, source_no int, low bigint, high bigint")
    owned = stored(owned, "owned").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))))
    dealt = ranked.join(owned, ["source_no", "cell"]).where("rank >= low AND rank < high")
    local = Window.partitionBy("shard").orderBy(
        F.xxhash64(F.lit(seed), "shard", "hash"), "hash", "row_id")
    draws = dealt.select(
        "shard", (F.row_number().over(local) - 1).alias("position"), "row_id", "doc_id", "block",
        "copy", "words", "source_no")
    return Mix(rows, sources, draws, block_words)


def split(quotas: np.ndarray, wanted: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour are among ``wanted`` draws without replacement from ``quotas``.

    Beyond the sampler's limit, units of several draws are dealt; what is left
    over is dealt in proportion, so the parts then hold ``wanted`` but for a few.
    """
    total = int(quotas.sum())
    unit = -(-total // _MOST_AT_ONCE) if total else 1
    if unit <= 1:
        return rng.multivariate_hypergeometric(quotas, wanted, method="marginals")
    units = quotas // unit
    most = int(units.sum())
    left = rng.multivariate_hypergeometric(
        units, min(most, wanted // unit), method="marginals") * unit
    return left + (quotas - units * unit) * wanted // total


def _leaves(quotas: list[tuple[int, int]], shards: int, seed: int):
    """Task function: shard numbers to the range of each source that the shard owns."""
    names = [name for name, _ in quotas]
    full = np.array([count for _, count in quotas], np.int64)

    def walk(shard: int) -> tuple[np.ndarray, np.ndarray]:
        low, high, count, first = 0, shards, full, np.zeros_like(full)
        while high - low > 1:
            middle = (low + high) // 2
            rng = np.random.Generator(np.random.PCG64([seed, low, high]))
            wanted = int(count.sum()) * (middle - low) // (high - low)
            left = split(count, wanted, rng)
            if shard < middle:
                high, count = middle, left
            else:
                low, count, first = middle, count - left, first + left
        return first, first + count

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                low, high = walk(int(shard))
                has = high > low
                yield pd.DataFrame({
                    "shard": int(shard), "source_no": np.array(names, np.int32)[has],
                    "low": low[has], "high": high[has]})

    return run


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs`` (doc_id, text, lang, source, n_chars and no others): a row for
    each pass in which a document has drawn blocks, with the text of these blocks.

    A document drawn whole keeps its text byte for byte; of another, the drawn
    blocks are joined in order, each up to the start of the next block.
    """
    mixed = mix(docs, keep=[c for c in docs.columns], **options)
    passes = mixed.draws.groupBy("row_id", "copy").agg(
        F.sort_array(F.collect_list("block")).alias("__blocks"))
    rows = mixed.rows.join(passes, "row_id")
    whole = F.size("__blocks") == F.ceil(F.col("size") / mixed.block_words)
    chosen = rows.select(*docs.columns, F.when(~whole, F.col("__blocks")).alias("__blocks"))
    return chosen.mapInArrow(
        _cut(mixed.block_words, docs.columns), T.StructType(docs.schema.fields))


def _cut(block_words: int, columns: Sequence[str]):
    """Task function: texts to the blocks that are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            wanted = batch.column("__blocks")
            if wanted.null_count == batch.num_rows:
                yield batch.select(list(columns))
                continue
            data, offsets = W.text_bytes(batch.column("text"))
            starts, _, bounds = W.word_places(data, offsets, W.NOT_SPACE)
            texts = batch.column("text").to_pylist()
            lengths = [None] * len(texts)
            for row, blocks in enumerate(wanted.to_pylist()):
                if blocks is None:
                    continue
                firsts = starts[bounds[row]:bounds[row + 1]:block_words].tolist()
                cuts = [int(offsets[row]), *firsts[1:], int(offsets[row + 1])]
                texts[row] = b"".join(
                    data[cuts[b]:cuts[b + 1]].tobytes() for b in blocks).decode()
                lengths[row] = len(texts[row])
            made = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in columns:
                known = batch.column("n_chars").to_pylist()
                made["n_chars"] = pa.array(
                    [k if n is None else n for k, n in zip(known, lengths)],
                    batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(
                [made.get(c, batch.column(c)) for c in columns], list(columns))

    return run
