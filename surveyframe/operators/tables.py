"""Grouped summaries, frequency tables and row-wise helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import (
    ColumnNames, col, cols, divide, is_not_binary, names, number, quoted, require, require_number,
    weight_or_one,
)
from ..plans.attach import join_groups, kept, with_only_row


# --- summaries ---------------------------------------------------------------

def group_moments(
    df: DataFrame, variables: ColumnNames, by: ColumnNames | None = None,
) -> DataFrame:
    """Rows, and per variable count, missing, sum, mean and standard deviation."""
    variables, by = names(variables), names(by)
    require(df, *by)
    require_number(df, *variables)
    measures = []
    for v in variables:
        value = number(v)
        measures += [
            F.count(value).alias(f"{v}_count"), F.count_if(value.isNull()).alias(f"{v}_missing"),
            F.sum(value).alias(f"{v}_sum"), F.avg(value).alias(f"{v}_mean"),
            F.stddev_samp(value).alias(f"{v}_sd"),
        ]
    return df.groupBy(*cols(by)).agg(F.count("*").alias("n"), *measures)


def weighted_mean(
    df: DataFrame, value: str, weight: str, by: ColumnNames | None = None,
) -> DataFrame:
    """Sum of weights and weighted mean per group, over rows that have a value."""
    by = names(by)
    require(df, *by)
    require_number(df, value, weight)
    y = number(value)
    w = F.when(y.isNotNull(), weight_or_one(weight))
    return df.groupBy(*cols(by)).agg(
        F.count(y).alias("n"), F.sum(w).alias("weight_sum"),
        divide(F.sum(w * y), F.sum(w)).alias("weighted_mean"),
    )


def pivot_group_means(
    df: DataFrame, value: str, group: str, levels: Sequence,
) -> DataFrame:
    """One row with the mean of every level, and first level minus second."""
    require(df, group)
    require_number(df, value)
    means = [
        F.avg(F.when(col(group) == F.lit(level), number(value))).alias(f"mean_{level}")
        for level in levels
    ]
    wide = df.filter(col(group).isin(list(levels))).agg(*means)
    if len(levels) < 2:
        return wide
    return wide.withColumn(
        "mean_difference", col(f"mean_{levels[0]}") - col(f"mean_{levels[1]}"))


def frequency_table(df: DataFrame, by: ColumnNames) -> DataFrame:
    """Rows per group and their share of all rows."""
    by = names(by)
    require(df, *by)
    counts = df.groupBy(*cols(by)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return with_only_row(counts, total).select(
        *cols(by), "n", divide(F.col("n").cast("double"), F.col("total")).alias("share"))


def crosstab(
    df: DataFrame, rows: str, columns: str, levels: Sequence | None = None,
) -> DataFrame:
    """Counts of ``rows`` by ``columns``, a column per level.

    Without ``levels`` Spark first looks the levels up.
    """
    require(df, rows, columns)
    if levels is None:
        wide = df.groupBy(col(rows)).pivot(quoted(columns)).count()
        return wide.na.fill(0, [c for c in wide.columns if c != rows])
    return df.groupBy(col(rows)).agg(*[
        F.count_if(col(columns).eqNullSafe(F.lit(level))).alias(str(level))
        for level in levels
    ])


def binary_violations(df: DataFrame, columns: ColumnNames) -> DataFrame:
    """Per column, how many rows hold something else than 0, 1 or NULL."""
    columns = names(columns)
    require_number(df, *columns)
    counted = df.agg(*[
        F.count_if(is_not_binary(number(c))).alias(f"bad{i}") for i, c in enumerate(columns)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(f"bad{i}").alias("violations"))
        for i, c in enumerate(columns)
    ])))


# --- group totals on rows ----------------------------------------------------

def group_total(
    df: DataFrame, value: str, by: ColumnNames, *,
    total: str = "group_total", count: str | None = None, share: str | None = None,
) -> DataFrame:
    """Every row with its group's total and, if named, row count and own share.

    The totals are aggregated before they meet the rows, so a hot group is not
    gathered in one task the way a window over the rows would gather it.
    """
    by = names(by)
    require(df, *by)
    require_number(df, value)
    taken = [c for c in (total, count, share) if c is not None and c in df.columns]
    if taken:
        raise ValueError(f"the table already has column(s) {taken}")
    stats = [F.sum(number(value)).alias(total)]
    if count:
        stats.append(F.count("*").alias(count))
    placed = join_groups(df, kept(df.groupBy(*cols(by)).agg(*stats)), by)
    if share:
        placed = placed.withColumn(share, divide(number(value), col(total)))
    return placed


# --- rows against the whole table --------------------------------------------

def split_by_mean(
    df: DataFrame, column: str, flag: str = "high", *, inclusive: bool = True,
) -> DataFrame:
    """Every row with a 0/1 flag: is the value at least (or above) the overall mean?"""
    require_number(df, column)
    value = number(column)
    mean = df.agg(F.avg(value).alias("__mean"))
    above = value >= F.col("__mean") if inclusive else value > F.col("__mean")
    return with_only_row(df, mean).select(
        *cols(df.columns), F.when(above, 1).when(~above, 0).alias(flag))


def filter_by_mean(
    df: DataFrame, column: str, *, above: bool = True, inclusive: bool = True,
) -> DataFrame:
    """Rows at least as large as the overall mean, or with ``above=False`` the smaller ones."""
    split = split_by_mean(df, column, "__high", inclusive=inclusive)
    return split.filter(F.col("__high") == (1 if above else 0)).drop("__high")


# --- stacking ----------------------------------------------------------------

def stack_tables(tables: Mapping[str, DataFrame], origin: str | None = "origin") -> DataFrame:
    """Tables on top of each other by column name, each row marked with its origin.

    Columns that a table lacks are NULL there.
    """
    marked = [
        df.withColumn(origin, F.lit(label)) if origin else df for label, df in tables.items()]
    if not marked:
        raise ValueError("no tables to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
