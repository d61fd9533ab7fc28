"""Exact quantiles (linear interpolation) that no single task has to hold.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.  That
is right for groups of ordinary size and is used for them.  In a large group the
wanted ranks are closed in first: sketches, merged through salts, give for each
rank a bracket that must contain it; the next pass looks only inside.  When the
brackets are small, one more pass counts the values inside them one by one and
everything else in bulk, which gives the exact values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, number
from .attach import join_groups, kept

# Rows of a group that one aggregation buffer, or one sorted window, may hold.
SMALL_GROUP = 100_000
# A sketch's rank error is one part in ACCURACY; it is read at POINTS steps.
ACCURACY = 5_000
POINTS = 500
# The tasks' sketches of a group are merged in parts, one per so many rows of the
# largest group; at most SALTS parts then meet.
ROWS_PER_SALT = 10_000_000
SALTS = 128


def quantiles(
    df: DataFrame, variables: Sequence[str], probabilities: Sequence[float],
    by: Sequence[str] = (), *, small_group: int = SMALL_GROUP,
) -> DataFrame:
    """One row per group, with an array column ``__q0``, ``__q1``, ... per variable.

    Groups of more than ``small_group`` rows go the way for large ones; the result
    is the same to the last bit.  Counts the rows of every group first, which reads
    only the grouping columns.  A variable without values has a NULL array.
    """
    probabilities = [float(p) for p in probabilities]
    rows, keys = _narrowed(df, variables, by)
    counts = rows.groupBy(*keys).count()
    if by:
        counts = kept(counts)
    is_large = F.col("count") > small_group
    groups, large, largest = counts.agg(
        F.count("*"), F.count_if(is_large), F.max("count")).first()
    if large == 0:
        found = _of_small_groups(rows, len(variables), probabilities, keys)
    elif large == groups:
        found = _of_large_groups(rows, len(variables), probabilities, keys, largest, small_group)
    else:
        marks = kept(counts.filter(is_large).select(*keys, F.lit(True).alias("__large")))
        marked = join_groups(rows, marks, keys)
        found = _of_large_groups(
            marked.filter(F.col("__large")), len(variables), probabilities, keys, largest,
            small_group,
        ).unionByName(_of_small_groups(
            marked.filter(F.col("__large").isNull()), len(variables), probabilities, keys))
    return _named(found, by)


def _narrowed(
    df: DataFrame, variables: Sequence[str], by: Sequence[str],
) -> tuple[DataFrame, list[str]]:
    """The rows under names of this module's own, and the names of the keys."""
    keys = [f"__by{i}" for i in range(len(by))]
    return df.select(
        *[col(b).alias(k) for b, k in zip(by, keys)],
        *[number(v).alias(f"__v{i}") for i, v in enumerate(variables)]), keys


def _named(found: DataFrame, by: Sequence[str]) -> DataFrame:
    return found.withColumnsRenamed({f"__by{i}": b for i, b in enumerate(by)})


def approximate_quantiles(
    df: DataFrame, variables: Sequence[str], probabilities: Sequence[float],
    by: Sequence[str] = (), *, accuracy: int = 10_000,
) -> DataFrame:
    """Like :func:`quantiles`, from Spark's sketch alone: one pass, no interpolation."""
    wanted = [float(p) for p in probabilities]
    rows, keys = _narrowed(df, variables, by)
    return _named(rows.groupBy(*keys).agg(*[
        F.percentile_approx(f"__v{i}", wanted, accuracy).alias(f"__q{i}")
        for i in range(len(variables))
    ]), by)


def _of_small_groups(
    rows: DataFrame, variables: int, probabilities: Sequence[float], by: Sequence[str],
) -> DataFrame:
    wanted = F.array(*[F.lit(p) for p in probabilities])
    return rows.groupBy(*by).agg(*[
        F.percentile(f"__v{i}", wanted).alias(f"__q{i}") for i in range(variables)])


def _of_large_groups(
    df: DataFrame, variables: int, probabilities: Sequence[float],
    by: Sequence[str], largest: int, small_group: int,
) -> DataFrame:
    keys = [*by, "variable"]
    rows = _stacked(df, variables, by)
    # The least and the largest value are found without a bracket.
    inner = sorted({p for p in probabilities if 0 < p < 1})
    brackets, inside = None, largest if inner else 0
    while inside > small_group:
        salts = max(1, min(SALTS, inside // ROWS_PER_SALT))
        brackets = kept(_closer_brackets(rows, keys, inner, brackets, salts))
        inside = int(inside * (4 / POINTS + 8 / ACCURACY))
    zoned = _zoned(rows, keys, len(inner), brackets)
    found = _picked(zoned, keys, probabilities)
    return found.groupBy(*by).agg(*[
        F.max(F.when(F.col("variable") == i, F.col("quantiles"))).alias(f"__q{i}")
        for i in range(variables)
    ])


def _stacked(df: DataFrame, variables: int, by: Sequence[str]) -> DataFrame:
    """A row (variable, value) for each variable of a row."""
    return df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("variable"), F.col(f"__v{i}").alias("value"))
        for i in range(variables)])))


def _zoned(
    rows: DataFrame, keys: Sequence[str], count: int, brackets: DataFrame | None,
) -> DataFrame:
    """Rows with the number of their zone and whether it lies inside a bracket.

    The ends of the brackets cut the values into zones, numbered upwards.
    """
    value = F.col("value")
    if brackets is None:
        return rows.select(
            *keys, "value", F.lit(0).alias("zone"), F.lit(count > 0).alias("inside"))
    begun, ended = F.lit(0), F.lit(0)
    for j in range(count):
        begun = begun + F.when(value >= F.col("low")[j], 1).otherwise(0)
        ended = ended + F.when(value > F.col("high")[j], 1).otherwise(0)
    return join_groups(rows, brackets, keys).select(
        *keys, "value", (begun + ended).alias("zone"), (begun > ended).alias("inside"))


def _closer_brackets(
    rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float],
    brackets: DataFrame | None, salts: int,
) -> DataFrame:
    """For every group and probability a (low, high) that contains the wanted ranks.

    Each task sketches its part of a zone; the sketches are merged per salt, and
    the salts' quantiles together bound the rank of any of them.
    """
    steps = ", ".join(f"{k / POINTS}D" for k in range(POINTS + 1))
    grid = F.expr(f"array({steps})")
    value = F.col("value")
    zoned = _zoned(rows, keys, len(probabilities), brackets)
    measures = [F.count("value").alias("held"), F.min("value").alias("least"),
                F.max("value").alias("most")]
    # Only rows inside a bracket are sketched; the zones between are counted.
    salted = zoned.filter("inside").withColumn("salt", F.spark_partition_id() % salts).groupBy(
        *keys, "zone", "salt").agg(
        *measures, F.percentile_approx(value, grid, ACCURACY).alias("points"))
    if brackets is not None:
        salted = salted.unionByName(zoned.filter("NOT inside").groupBy(*keys, "zone").agg(
            *measures).withColumn("points", F.lit(None)), allowMissingColumns=True)
    salted = kept(salted)
    group, zone = Window.partitionBy(*keys), Window.partitionBy(*keys, "zone")
    placed = salted.select(
        *keys, "points", (F.col("held") / POINTS).alias("weight"),
        F.sum("held").over(group).alias("n"),
        F.sum("held").over(group.orderBy("zone")).alias("upto"),
        F.sum("held").over(zone).alias("zone_held"),
        F.min("least").over(zone).alias("zone_least"),
        F.max("most").over(zone).alias("zone_most"),
    )
    # 0-based rank within the one zone that holds it; -1 rows when there is no value at all.
    rank = F.floor((F.col("n") - 1) * F.col("wanted.p")) - (F.col("upto") - F.col("zone_held"))
    targets = (
        placed.select("*", _each(probabilities).alias("wanted")).withColumn("rank", rank)
        .filter(((F.col("rank") >= 0) & (F.col("rank") < F.col("zone_held"))) | (F.col("n") == 0))
        .select(*keys, F.col("wanted.j").alias("j"), "rank", "weight", "zone_held",
                "zone_least", "zone_most", F.explode_outer("points").alias("point"))
    )
    reached = F.sum("weight").over(Window.partitionBy(*keys, "j").orderBy("point"))
    error = F.col("zone_held") * (1 / POINTS + 2 / ACCURACY) + (salts + 1)
    point = F.col("point")
    bounds = targets.withColumn("reached", reached).groupBy(*keys, "j").agg(
        F.coalesce(
            F.max(F.when(F.col("reached") + error <= F.col("rank"), point)),
            F.min("zone_least")).alias("low"),
        F.coalesce(
            F.min(F.when(F.col("reached") - error >= F.col("rank") + 2, point)),
            F.max("zone_most")).alias("high"),
    )

    def listed(end: str) -> Column:
        return F.array(*[
            F.max(F.when(F.col("j") == j, col(end))) for j in range(len(probabilities))])

    return bounds.groupBy(*keys).agg(listed("low").alias("low"), listed("high").alias("high"))


def _each(probabilities: Sequence[float]) -> Column:
    """A row (j, p) for every probability."""
    return F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), F.lit(p).alias("p")) for j, p in enumerate(probabilities)]))


def _picked(zoned: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """The exact quantiles of every group and variable.

    Values inside a bracket are counted one by one, those between two brackets
    together.  Both kinds of cells lie in order, so running counts give the ranks
    each covers.  Of the cells between brackets only the ends can be wanted.
    """
    return _picked_from(_cells(zoned, keys), keys, probabilities)


def _cells(zoned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and values of each zone, inside brackets for each value apart."""
    return zoned.withColumn("single", F.when(F.col("inside"), F.col("value"))).groupBy(
        *keys, "zone", "single").agg(
        F.count("value").alias("held"), F.min("value").alias("first"),
        F.max("value").alias("last"), F.count("*").alias("rows"))


def _picked_from(
    cells: DataFrame, keys: Sequence[str], probabilities: Sequence[float],
) -> DataFrame:
    group = Window.partitionBy(*keys)
    running = group.orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = (F.col("n") - 1) * F.col("wanted.p")
    ranked = cells.select(
        *keys, "first", "last",
        (F.sum("held").over(running) - 1).alias("end"),
        (F.sum("held").over(running) - F.col("held")).alias("start"),
        F.sum("held").over(group).alias("n"),
    ).select("*", _each(probabilities).alias("wanted")).withColumns({
        "place": place, "under": F.floor(place), "over": F.ceil(place)})

    def covers(rank: str) -> Column:
        return col(rank).between(F.col("start"), F.col("end"))

    def at(rank: str) -> Column:
        """The value of a 0-based rank if this cell covers it."""
        missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        first, last = F.col("first"), F.col("last")
        found = F.when((col(rank) == F.col("start")) | (first == last), first)
        return F.when(covers(rank), found.when(col(rank) == F.col("end"), last).otherwise(missed))

    nothing = F.col("n") == 0
    # In the order in which Spark's percentile computes it, so that both ways agree exactly.
    low, high, position = F.col("low"), F.col("high"), F.col("place")
    between = F.when((F.col("under") == F.col("over")) | (low == high), low).otherwise(
        (F.col("over") - position) * low + (position - F.col("under")) * high)
    picked = (
        ranked.filter(covers("under") | covers("over") | nothing)
        .groupBy(*keys, "wanted.j").agg(
            F.max(at("under")).alias("low"), F.max(at("over")).alias("high"),
            *[F.max(c).alias(c) for c in ("place", "under", "over")])
        .withColumn("quantile", between)
    )
    found = [
        F.max(F.when(F.col("j") == j, F.col("quantile"))) for j in range(len(probabilities))]
    listed = F.when(F.count("quantile") > 0, F.array(*found))
    return picked.groupBy(*keys).agg(listed.alias("quantiles"))
