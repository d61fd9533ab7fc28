"""Moments of two samples, for one or many variables, as one row per variable.

The samples are two named levels of a grouping column.  One aggregate reads
every variable at once, with and without weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, number, require, require_number, weight_or_one
from . import weighted_moments as weighted

SIDES = ("x", "y")


def two_samples(
    df: DataFrame, variables: Sequence[str], group: str, x, y, weight: str | None = None,
) -> DataFrame:
    """The rows of the two levels, narrowed to what the moments need."""
    require(df, group)
    require_number(df, *variables, weight)
    if x == y:
        raise ValueError("the two samples need different levels")
    values = [number(v).alias(f"v{i}") for i, v in enumerate(variables)]
    weights = [weight_or_one(weight).alias("w")] if weight else []
    level = F.when(col(group) == F.lit(x), "x").otherwise("y").alias("side")
    return df.filter(col(group).isin(x, y)).select(level, *weights, *values)


def two_sample_moments(
    df: DataFrame, variables: Sequence[str], group: str, x, y, weight: str | None = None,
) -> DataFrame:
    """One row per variable with both samples' counts, means and variances.

    Columns for side ``x`` (``y`` likewise): ``x_n`` values present, ``x_missing``,
    ``x_mean``, ``x_var``.  With a weight also ``x_flat`` (all weights equal),
    ``x_wn`` rows with value and weight, ``x_wsum`` their weight, ``x_wmean``,
    ``x_wspread`` the weighted sum of squared deviations and ``x_wscore`` the sum
    of squared weighted deviations.
    """
    rows = two_samples(df, variables, group, x, y, weight)
    wide = _weighted_moments(rows, len(variables)) if weight else rows.agg(*[
        F.expr(text) for side in SIDES for text in _plain_moments(side, range(len(variables)))])
    measures = _MEASURES + (_WEIGHTED_MEASURES if weight else [])

    def row(i: int, name: str) -> Column:
        fields = ", ".join(
            f"{side}{i}_{m} AS {side}_{m}" for side in SIDES for m in measures)
        return F.struct(
            F.lit(i).alias("variable_index"), F.lit(name).alias("variable"),
            F.expr(f"struct({fields})").alias("moments"))

    rows_of_variables = wide.select(F.inline(F.array(*[
        row(i, name) for i, name in enumerate(variables)])))
    return rows_of_variables.select("variable_index", "variable", "moments.*")


_MEASURES = ["n", "missing", "mean", "var"]
_WEIGHTED_MEASURES = ["flat", "wn", "wsum", "wmean", "wspread", "wscore"]
_OF_NOTHING = {"n": "0L", "missing": "0L", "wn": "0L", "flat": "true"}


def _plain_moments(side: str, indices: Sequence[int]) -> list[str]:
    here = f"side = '{side}'"
    return [
        text for i in indices for text in (
            f"count(CASE WHEN {here} THEN v{i} END) AS {side}{i}_n",
            f"count_if({here} AND v{i} IS NULL) AS {side}{i}_missing",
            f"avg(CASE WHEN {here} THEN v{i} END) AS {side}{i}_mean",
            f"var_samp(CASE WHEN {here} THEN v{i} END) AS {side}{i}_var",
        )
    ]


def _weighted_moments(rows: DataFrame, variables: int) -> DataFrame:
    """The moments of every variable and side in one row.

    Each row is turned into one per variable, so the aggregates, and the code that Spark makes of
    them, are as many for any number of variables.  They are combined per task.
    """
    stacked = rows.select("side", "w", F.posexplode(F.array(*[
        F.col(f"v{i}") for i in range(variables)])).alias("i", "v"))
    square = "square_"
    sums = stacked.selectExpr("i", "side", "w", "v", *weighted.split("v")).groupBy("i", "side").agg(
        *[F.expr(text) for text in (
            "count(v) AS n", "count_if(v IS NULL) AS missing", "avg(v) AS mean", "var_samp(v) AS var",
            "(min(w) <=> max(w) AND count(w) IN (0, count(*))) AS flat",
            *weighted.sums("w", ["v"], [("v", "v")]),
            *weighted.sums("w * w", ["v"], [("v", "v")], tag=square))])
    moments = sums.selectExpr(
        "i", "side", "n", "missing", "mean", "var", "flat", "v_n AS wn", "v_w AS wsum",
        f"{weighted.mean('v')} AS wmean", f"{weighted.spread('v', 'v')} AS wspread",
        f"{weighted.score('v', '', square)} AS wscore")
    held = ", ".join(_MEASURES + _WEIGHTED_MEASURES)
    places = [(side, i) for side in SIDES for i in range(variables)]
    wide = moments.selectExpr("i", "side", f"struct({held}) AS m").agg(*[
        F.expr(f"any_value(m) FILTER (WHERE i = {i} AND side = '{side}') AS {side}{i}")
        for side, i in places])
    return wide.selectExpr(*[
        f"coalesce({side}{i}.{m}, {_OF_NOTHING[m]}) AS {side}{i}_{m}" if m in _OF_NOTHING
        else f"{side}{i}.{m} AS {side}{i}_{m}"
        for side, i in places for m in _MEASURES + _WEIGHTED_MEASURES])
