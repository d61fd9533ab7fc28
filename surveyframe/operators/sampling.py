"""Reproducible random weights and stratified splits.

Randomness comes from a hash of a row key and a seed, so that a row always gets
the same draw, whatever the partitioning and however often a task is repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import (
    ColumnNames, col, cols, divide, names, number, require, require_number,
)
from ..plans.attach import join_groups, kept, with_only_row
from ..plans.quantiles import quantiles

# The strata of a design are dealt a total in one row; more of them are refused.
MAX_STRATA = 100_000


def keyed_digest(key: str, seed: int | str) -> Column:
    """Hash of a key and a seed, as hexadecimal text."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"|{seed}")))


def grid_weight(
    key: str, seed: int | str, *, start: float = 1.0, step: float = 0.1, points: int = 11,
) -> Column:
    """A weight drawn from the grid start, start + step, ..., by key and seed."""
    draw = F.conv(F.substring(keyed_digest(key, seed), 1, 8), 16, 10).cast("bigint")
    return F.lit(start) + (draw % points) * F.lit(step)


def stratified_split(
    df: DataFrame, strata: ColumnNames, key: str, *, seed: int | str = 1,
    proportion: float = 0.5, flag: str = "in_first",
) -> DataFrame:
    """Every row with a 0/1 flag: is it in the first part of its stratum?

    Exactly ``ceil(proportion * rows)`` rows of each stratum are, those with the
    smallest hashes of the unique column ``key``.  No stratum is sorted whole:
    counts per slice of the hash range show in which slice the cut lies, and only
    that slice is ranked.  A missing key stops the job, and so does a key on the cut
    that another row of the stratum has too.
    """
    strata = names(strata)
    require(df, key, *strata)
    if not 0 < proportion < 1:
        raise ValueError("proportion must lie between 0 and 1")
    own = [f"__stratum{i}" for i in range(len(strata))]
    missing = F.raise_error(F.lit(f"{key} must not be NULL")).cast("string")
    keyed = df.select(
        *[col(s).alias(o) for s, o in zip(strata, own)], col(key).alias("__key"),
        F.when(col(key).isNull(), missing).otherwise(keyed_digest(key, seed)).alias("__hash"))
    # Slices of about sqrt(n) of the largest stratum's n rows.
    largest = keyed.groupBy(*own).count().agg(F.max("count")).first()[0] or 1
    digits = int(math.log2(largest) / 8)
    slice_of = F.left("__hash", F.lit(digits))

    stratum = Window.partitionBy(*own)
    upto = stratum.orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.ceil(F.sum("held").over(stratum) * F.lit(proportion))
    cut_slices = kept(
        keyed.groupBy(*own, slice_of.alias("__slice")).agg(F.count("*").alias("held"))
        .select(*own, "__slice", "held", F.sum("held").over(upto).alias("upto"),
                wanted.alias("wanted"))
        .filter((F.col("upto") >= F.col("wanted"))
                & (F.col("upto") - F.col("held") < F.col("wanted")))
        .select(*own, F.col("__slice").alias("__cut_slice"),
                (F.col("wanted") - F.col("upto") + F.col("held")).alias("__still_wanted"))
    )
    in_cut = join_groups(keyed, cut_slices, own).filter(slice_of == F.col("__cut_slice"))
    order = stratum.orderBy("__hash", "__key")
    cut = F.struct(F.col("__hash").alias("hash"), F.col("__key").alias("key"))
    tied = F.raise_error(F.lit(f"{key} must be unique: two rows meet at the cut"))
    cuts = kept(
        in_cut.withColumns({"__rank": F.row_number().over(order),
                            "__next": F.lead("__key").over(order)})
        .filter(F.col("__rank") == F.col("__still_wanted"))
        .select(*own, F.when(F.col("__next") == F.col("__key"), tied).otherwise(cut)
                .alias("__cut"))
        .withColumnsRenamed(dict(zip(own, strata)))
    )
    mine = F.struct(keyed_digest(key, seed).alias("hash"), col(key).alias("key"))
    return join_groups(df, cuts, strata).select(
        *cols(df.columns), F.when(mine <= F.col("__cut"), 1).otherwise(0).alias(flag))


def _keyed(df: DataFrame, strata: list[str], key: str, seed: int | str) -> DataFrame:
    """(__stratum0, ..., __key, __hash) of every row; a missing key stops the job."""
    missing = F.raise_error(F.lit(f"{key} must not be NULL")).cast("string")
    return df.select(
        *[col(s).alias(f"__stratum{i}") for i, s in enumerate(strata)], col(key).alias("__key"),
        F.when(col(key).isNull(), missing).otherwise(keyed_digest(key, seed)).alias("__hash"))


def _cuts(
    df: DataFrame, strata: list[str], key: str, seed: int | str, count: int,
    wanted: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(strata, __cuts): by stratum, up to which (hash, key) the first rows go, for ``count`` cuts.

    ``wanted`` adds ``__wanted``, an array of so many numbers of rows, to the strata and their
    sizes (``__n``).  A cut for no rows is NULL.  All cuts are found in one pass: counts by slice
    of the hash range tell the slice in which each lies, and only those are ranked.
    """
    keyed = _keyed(df, strata, key, seed)
    own = [f"__stratum{i}" for i in range(len(strata))]
    sizes = kept(wanted(keyed.groupBy(*own).agg(F.count("*").alias("__n"))))
    largest = sizes.agg(F.max("__n")).first()[0] or 1
    slice_of = F.left("__hash", F.lit(int(math.log2(largest) / 8)))

    stratum = Window.partitionBy(*own)
    upto = stratum.orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = keyed.groupBy(*own, slice_of.alias("__slice")).agg(F.count("*").alias("held")).select(
        *own, "__slice", "held", F.sum("held").over(upto).alias("upto"))
    each = F.posexplode("__wanted").alias("__number", "__rows")
    before = F.col("upto") - F.col("held")
    cut_slices = kept(join_groups(slices, sizes, own).select(
        *own, "__slice", "held", "upto", each).filter(
        (F.col("__rows") > before) & (F.col("__rows") <= F.col("upto"))).groupBy(
        *own, "__slice").agg(F.collect_list(F.struct(
            "__number", (F.col("__rows") - before).alias("still"))).alias("__here")))
    ranked = join_groups(
        keyed.withColumn("__slice", slice_of), cut_slices, [*own, "__slice"]).filter(
        F.col("__here").isNotNull())
    order = Window.partitionBy(*own, "__slice").orderBy("__hash", "__key")
    cut = F.struct(F.col("__hash").alias("hash"), F.col("__key").alias("key"))
    tied = F.raise_error(F.lit(f"{key} must be unique: two rows meet at the cut"))
    at_cut = ranked.withColumns({
        "__rank": F.row_number().over(order), "__next": F.lead("__key").over(order)}).select(
        *own, "__key", "__next", "__rank", cut.alias("__cut"), F.inline("__here")).filter(
        F.col("__rank") == F.col("still"))
    found = at_cut.select(
        *own, "__number",
        F.when(F.col("__next") == F.col("__key"), tied).otherwise(F.col("__cut")).alias("__cut"))
    return kept(found.groupBy(*own).agg(F.array(*[
        F.max(F.when(F.col("__number") == i, F.col("__cut"))) for i in range(count)
    ]).alias("__cuts")).withColumnsRenamed(dict(zip(own, strata))))


def stratified_parts(
    df: DataFrame, strata: ColumnNames, key: str, shares: Sequence[float], *,
    seed: int | str = 1, part: str = "part",
) -> DataFrame:
    """Every row with the number of its part, from 1: each stratum is split by ``shares``.

    The first k parts of a stratum together hold exactly ``ceil(their share * rows)`` of its rows, in
    the order of the hashes of the unique column ``key``; ``shares`` add up to 1.  With two parts
    the first is that of :func:`stratified_split`.  Without strata the table is one.  A missing or repeated key stops the job as there.
    """
    strata, shares = names(strata), list(shares)
    require(df, key, *strata)
    if any(s <= 0 for s in shares) or abs(sum(shares) - 1) > 1e-9 or len(shares) < 2:
        raise ValueError("shares must be two or more, above 0, and add up to 1")
    if not strata:
        return stratified_parts(
            df.withColumn("__all", F.lit(1)), "__all", key, shares, seed=seed, part=part,
        ).drop("__all")
    ends = [round(e, 12) for e in accumulate(shares)][:-1]
    cuts = _cuts(df, strata, key, seed, len(ends), lambda sizes: sizes.withColumn(
        "__wanted", F.array(*[F.ceil(F.col("__n") * F.lit(e)) for e in ends])))
    mine = F.struct(keyed_digest(key, seed).alias("hash"), col(key).alias("key"))
    beyond = F.filter("__cuts", lambda cut: cut < mine)
    return join_groups(df, cuts, strata).select(
        *cols(df.columns), (F.size(beyond) + 1).alias(part))


def value_brackets(
    df: DataFrame, variable: str, *, groups: int = 5, bracket: str = "bracket",
) -> DataFrame:
    """Every row with the number of the bracket that its value falls into, as strata for a split.

    ``groups`` evenly spaced quantiles, least and largest value included, are the ends; a value at an
    end belongs to the bracket below, and ends that coincide count once.  A row without value
    has no bracket.
    """
    require_number(df, variable)
    if groups < 2:
        raise ValueError("two groups are the least")
    ends = quantiles(df, [variable], [i / (groups - 1) for i in range(groups)])
    placed = with_only_row(df, ends.select(F.array_distinct("__q0").alias("__ends")))
    inner = F.slice("__ends", 2, F.greatest(F.size("__ends") - 2, F.lit(0)))
    value = number(variable)
    return placed.select(*cols(df.columns), F.when(
        value.isNotNull(), F.size(F.filter(inner, lambda e: e < value)) + 1).alias(bracket))


def allocate(
    strata: DataFrame, total: int, size: str, *, by: ColumnNames, spread: str | None = None,
    allocated: str = "allocated",
) -> DataFrame:
    """``total`` rows dealt to strata in whole numbers, in proportion to ``size``.

    ``strata`` has a row for each stratum with its number of rows in ``size``; with ``spread``, its
    standard deviation, the shares go by size times spread, which makes the total's error least.  No
    stratum gets more than its rows: what is beyond goes to the others.  Parts of a row go to the
    largest remainders, of equal ones to the stratum that comes first.  A stratum listed twice
    or without a size, and a total beyond all rows, stop the job; a missing spread counts as 0.
    """
    by = names(by)
    require(strata, *by)
    require_number(strata, size, spread)
    if total < 0:
        raise ValueError("the total must not be below zero")
    measure = col(size).cast("double")
    if spread:
        measure = measure * F.coalesce(number(spread), F.lit(0.0))
    entry = F.struct(
        F.struct(*cols(by)).alias("of"), col(size).cast("bigint").alias("n"), measure.alias("m"))
    listed = strata.agg(
        F.sort_array(F.collect_list(entry)).alias("all"), F.count("*").alias("rows"),
        F.count_distinct(F.struct(*cols(by))).alias("different"),
        F.coalesce(F.sum(col(size).cast("bigint")), F.lit(0)).alias("available"),
        F.count_if(col(size).isNull() | (col(size) < 0)).alias("unknown"))
    wrong = (
        F.when(F.col("rows") > MAX_STRATA, f"more than {MAX_STRATA} strata")
        .when(F.col("different") < F.col("rows"), "a stratum is listed twice")
        .when(F.col("unknown") > 0, "a stratum has no size")
        .when(F.col("available") < total, "the total is larger than all strata"))
    listed = listed.withColumn("all", F.when(
        wrong.isNotNull(), F.raise_error(wrong).cast(listed.schema["all"].dataType)).otherwise(
        F.col("all")))

    # Strata that would get more than they have are filled, those that fill up soonest first.
    def soonest(a: Column, b: Column) -> Column:
        left, right = a["n"] * b["m"], b["n"] * a["m"]
        return F.when(left < right, -1).when(left > right, 1).otherwise(0)

    def filled(state: Column, e: Column) -> Column:
        full = (e["m"] > 0) & (state["left"] * e["m"] >= e["n"] * state["m"])
        return F.struct(
            F.when(full, state["left"] - e["n"]).otherwise(state["left"]).alias("left"),
            F.when(full, state["m"] - e["m"]).otherwise(state["m"]).alias("m"),
            F.when(full, state["full"] + 1).otherwise(state["full"]).alias("full"))

    by_fill = F.array_sort(F.filter("all", lambda e: e["m"] > 0), soonest)
    start = F.struct(
        F.lit(float(total)).alias("left"),
        F.aggregate("all", F.lit(0.0), lambda t, e: t + e["m"]).alias("m"), F.lit(0).alias("full"))
    level = listed.withColumn("state", F.aggregate(by_fill, start, filled)).withColumn(
        "level", F.when(F.col("state.full") == F.size(by_fill), F.lit(math.inf)).otherwise(
            F.coalesce(divide(F.col("state.left"), F.col("state.m")), F.lit(0.0))))

    def shared(e: Column) -> Column:
        share = F.when(e["m"] > 0, F.least(F.col("level") * e["m"], e["n"].cast("double"))).otherwise(
            F.lit(0.0))
        whole = F.floor(share)
        return F.struct(
            e["of"].alias("of"), e["n"].alias("n"), whole.alias("whole"),
            (share - whole).alias("rest"))

    level = level.withColumn("dealt", F.transform("all", shared))
    missing = F.lit(total) - F.aggregate(
        "dealt", F.lit(0).cast("bigint"), lambda t, e: t + e["whole"])
    # Strata without spread take rows only when all others are full.
    ranked = F.sort_array(F.transform(
        F.filter("dealt", lambda e: e["whole"] < e["n"]),
        lambda e: F.struct((-e["rest"]).alias("rest"), e["of"].alias("of"))))
    chosen = level.withColumn("missing", missing).withColumn(
        "more", F.transform(F.slice(ranked, 1, F.greatest(F.col("missing"), F.lit(0)).cast("int")),
                            lambda e: e["of"]))
    found = chosen.select(F.inline(F.transform("dealt", lambda e: F.struct(
        e["of"].alias("of"),
        (e["whole"] + F.array_contains("more", e["of"]).cast("bigint")).alias("got"),
        F.size("more").alias("given"), F.col("missing").alias("missing")))))
    short = F.raise_error(F.lit("the total is larger than the strata with a spread hold"))
    return found.select(
        *[F.col("of").getField(b).alias(b) for b in by],
        F.when(F.col("missing") > F.col("given"), short.cast("bigint")).otherwise(F.col("got"))
        .alias(allocated))


def stratified_draw(
    df: DataFrame, strata: ColumnNames, key: str, allocation: DataFrame, count: str, *,
    seed: int | str = 1,
) -> DataFrame:
    """Exactly ``count`` rows of each stratum of ``allocation``, all columns, drawn without replacement.

    The rows with the smallest hashes of the unique column ``key`` and the seed are drawn, so the draw
    stays the same however ``df`` is partitioned.  Strata that the allocation leaves out give no rows; a
    stratum with fewer rows than its count, or listed twice, stops the job.
    """
    strata = names(strata)
    require(df, key, *strata)
    require(allocation, *strata)
    require_number(allocation, count)
    own = [f"__stratum{i}" for i in range(len(strata))]
    wanted = kept(allocation.select(
        *[col(s).alias(o) for s, o in zip(strata, own)], col(count).cast("bigint").alias("__rows")
    ).groupBy(*own).agg(F.max("__rows").alias("__rows"), F.count("*").alias("__listed")))
    lacking = F.concat(F.lit("fewer rows than are to be drawn in stratum: "), F.concat_ws(
        ", ", *[F.coalesce(F.col(o).cast("string"), F.lit("NULL")) for o in own]))
    wrong = F.when(F.col("__listed") > 1, F.lit("the allocation lists a stratum twice")).when(
        F.col("__rows") > F.col("__n"), lacking)

    def counted(sizes: DataFrame) -> DataFrame:
        every = join_groups(wanted, kept(sizes), own).withColumn(
            "__n", F.coalesce("__n", F.lit(0)))
        return every.select(*own, "__n", F.when(
            wrong.isNotNull(), F.raise_error(wrong).cast("array<bigint>")).otherwise(
            F.array("__rows")).alias("__wanted"))

    cuts = _cuts(df, strata, key, seed, 1, counted)
    mine = F.struct(keyed_digest(key, seed).alias("hash"), col(key).alias("key"))
    return join_groups(df, cuts, strata).filter(
        mine <= F.get("__cuts", F.lit(0))).select(*cols(df.columns))
