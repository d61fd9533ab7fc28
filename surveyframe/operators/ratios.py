"""Means of ratios, ratios of means, and shares of categories within persons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    ColumnNames, col, cols, divide, names, not_in, number, ratio, require, require_number,
)
from ..plans.attach import join_groups, kept

# Rows that one row is multiplied into at a time.
LISTED_AT_ONCE = 65_536


def mean_of_ratios(
    df: DataFrame, top: str, bottom: str, by: ColumnNames | None = None,
) -> DataFrame:
    """The mean of the rows' ratios next to the ratio of the means and of the sums."""
    by = names(by)
    require(df, *by)
    require_number(df, top, bottom)
    t, b = number(top), number(bottom)
    return df.groupBy(*cols(by)).agg(
        F.count("*").alias("n"), F.avg(t).alias("mean_top"), F.avg(b).alias("mean_bottom"),
        F.avg(ratio(top, bottom)).alias("mean_of_ratios"),
        divide(F.avg(t), F.avg(b)).alias("ratio_of_means"),
        divide(F.sum(t), F.sum(b)).alias("ratio_of_sums"),
    )


def person_category_counts(
    df: DataFrame, person: str, date: str, category: str, *,
    relabelled: DataFrame | None = None, relabelled_key: str | None = None,
    new_label: str | None = None, excluded_labels: Sequence[str] = (),
    attributes: DataFrame | None = None, attributes_key: str | None = None,
    attributes_filter: Column | None = None, attribute_columns: Sequence[str] = (),
) -> DataFrame:
    """How many dates each person had each category, as ``person, category, dates, sets``.

    Persons listed in ``relabelled`` have all their categories replaced by
    ``new_label``.  Rows whose label is excluded are dropped after that; rows
    without a label stay.  ``attributes`` (filtered first) belong to the person:
    ``sets`` is the person's number of distinct sets of them, one where there is
    none, and a date counts once per set.  Dates and sets are counted apart and
    multiplied, so their pairs are never written out.
    """
    require(df, person, date, category)
    # Once per person, date and category first: all that follows is small.
    events = df.select(
        col(person).alias("person"), col(date).alias("date"),
        col(category).alias("category")).distinct()
    if relabelled is not None:
        events = member_flag(
            events, "person", relabelled, relabelled_key or person, "listed",
        ).select("person", "date", F.when(F.col("listed"), F.lit(new_label)).otherwise(
            F.col("category")).alias("category")).distinct()
    if excluded_labels:
        events = events.filter(not_in("category", excluded_labels))
    counted = events.groupBy("person", "category").agg(F.count("*").alias("days"))
    if attributes is None:
        return counted.select(
            "person", "category", F.col("days").alias("dates"), F.lit(1).cast("bigint").alias("sets"))

    wanted = attributes if attributes_filter is None else attributes.filter(attributes_filter)
    sets = (
        wanted.select(col(attributes_key or person).alias("__owner"), *cols(attribute_columns))
        .distinct().groupBy("__owner").agg(F.count("*").alias("held"))
    )
    held = F.coalesce(F.col("held"), F.lit(1).cast("bigint"))
    return counted.join(sets, F.col("person").eqNullSafe(F.col("__owner")), "left").select(
        "person", "category", (F.col("days") * held).alias("dates"), held.alias("sets"))


def listed_counts(counts: DataFrame, first_rows: int | None = None) -> DataFrame:
    """The counts with one row per set of attributes; optionally only the first in key order.

    Rows are multiplied in steps, so that no row holds a long list.
    """
    rows = counts.select("person", "category", "dates", F.col("sets").alias("__left"))
    for size in (LISTED_AT_ONCE**2, LISTED_AT_ONCE, 1):
        whole = F.floor((F.col("__left") - 1) / F.lit(size))
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), whole)).alias("__part")
        rows = rows.select("person", "category", "dates", "__left", part).select(
            "person", "category", "dates",
            F.least(F.col("__left") - F.col("__part") * size, F.lit(size)).alias("__left"))
    rows = rows.drop("__left")
    if first_rows is None:
        return rows
    return rows.orderBy("person", "category", "dates").limit(first_rows)


def category_shares(counts: DataFrame) -> DataFrame:
    """Per category: persons, and means of their counts, totals, shares and categories.

    ``counts`` comes from :func:`person_category_counts`.  Every set of attributes
    weighs as a row of its own, which ``sets`` stands for.  Persons' totals are
    aggregated and joined back, so a person with many categories is not gathered.
    """
    counts, sets = kept(counts), F.col("sets")
    totals = kept(counts.groupBy("person").agg(
        F.sum(F.col("dates") * sets).alias("total"), F.sum("sets").alias("categories")))
    placed = join_groups(counts, totals, ["person"])
    share = divide(F.col("dates").cast("double"), F.col("total").cast("double"))

    def mean(value: Column) -> Column:
        return divide(F.sum((value * sets).cast("double")), F.sum("sets"))

    return placed.groupBy("category").agg(
        F.sum("sets").alias("persons"), mean(F.col("dates")).alias("mean_dates"),
        mean(F.col("total")).alias("mean_total"), mean(share).alias("mean_share"),
        mean(F.col("categories")).alias("mean_categories"),
    )


def member_flag(
    df: DataFrame, column: str, other: DataFrame, other_column: str, flag: str,
) -> DataFrame:
    """Every row with a boolean: does its value occur in the other table's column?"""
    require(df, column)
    require(other, other_column)
    keys = other.select(col(other_column).alias("__member")).distinct().withColumn(
        flag, F.lit(True))
    joined = df.join(keys, col(column).eqNullSafe(F.col("__member")), "left")
    return joined.select(*cols(df.columns), F.coalesce(col(flag), F.lit(False)).alias(flag))
