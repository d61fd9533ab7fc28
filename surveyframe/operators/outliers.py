"""Outliers by Tukey's fences: summary, flags, removal and histograms.

A value at or beyond ``q25 - 1.5 iqr`` or ``q75 + 1.5 iqr`` is an outlier.  A
variable with a single distinct value has no fences and no outliers.  When the
quartiles coincide but the values do not, every value at the quartiles is at
both fences and counts as an outlier on both sides.

``buffer_rows`` says how many rows of a group one task may hold while it looks for
the quartiles; larger groups are bracketed first.  It changes the plan, not the
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    ColumnNames, col, cols, divide, names, number, require, require_number,
)
from ..plans.attach import kept, with_only_row, with_stats
from ..plans.quantiles import SMALL_GROUP, approximate_quantiles, quantiles
from ..plans.sketches import quantiles_of_cells, summary_cells, write_sketches

FIVE_NUMBERS = [0.0, 0.25, 0.5, 0.75, 1.0]
_QUANTILE_NAMES = ["q0", "q25", "q50", "q75", "q100"]
FENCE = 1.5
SIDES = ("both", "upper", "lower")
HISTOGRAM_BINS = 30


def _five_numbers(
    df: DataFrame, variables: list[str], by: list[str], approximate: bool, buffer_rows: int,
) -> DataFrame:
    require(df, *by)
    require_number(df, *variables)
    clash = set(variables) & set(by)
    if clash:
        raise ValueError(f"{sorted(clash)} cannot be both grouped by and summarised")
    if approximate:
        return approximate_quantiles(df, variables, FIVE_NUMBERS, by)
    return quantiles(df, variables, FIVE_NUMBERS, by, small_group=buffer_rows)


def _refuse_outputs(by: list[str], outputs: list[str]) -> None:
    taken = sorted(set(by) & set(outputs))
    if taken:
        raise ValueError(f"rename grouping column(s) {taken}: the result has columns of that name")


def five_number_summary(
    df: DataFrame, variables: ColumnNames, by: ColumnNames | None = None, *,
    approximate: bool = False, buffer_rows: int = SMALL_GROUP,
) -> DataFrame:
    """Minimum, quartiles and maximum per variable and group."""
    variables, by = names(variables), names(by)
    _refuse_outputs(by, ["variable", *_QUANTILE_NAMES])
    wide = _five_numbers(df, variables, by, approximate, buffer_rows)
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("variable"),
            *[col(f"__q{i}")[k].alias(q) for k, q in enumerate(_QUANTILE_NAMES)],
        )
        for i, name in enumerate(variables)
    ])
    return wide.select(*cols(by), F.inline(rows))


def quantiles_long(
    df: DataFrame, variable: str, by: ColumnNames | None = None, *,
    approximate: bool = False, buffer_rows: int = SMALL_GROUP,
) -> DataFrame:
    """The five quantiles of a variable as rows (name, value) per group."""
    by = names(by)
    wide = _five_numbers(df, [variable], by, approximate, buffer_rows)
    rows = F.array(*[
        F.struct(F.lit(f"{int(100 * p)}%").alias("name"), F.col("__q0")[k].alias("value"))
        for k, p in enumerate(FIVE_NUMBERS)
    ])
    return wide.select(*cols(by), F.inline(rows))


def _fences(
    df: DataFrame, variables: list[str], by: list[str], approximate: bool, buffer_rows: int,
) -> DataFrame:
    """Per group and variable ``i``: quantiles ``__q<i>`` and fences ``__low<i>``, ``__high<i>``."""
    wide = _five_numbers(df, variables, by, approximate, buffer_rows)
    found = []
    for i in range(len(variables)):
        q = col(f"__q{i}")
        iqr = q[3] - q[1]
        spread = q[0] != q[4]
        found += [
            F.when(spread, q).alias(f"__q{i}"),
            F.when(spread, q[1] - FENCE * iqr).alias(f"__low{i}"),
            F.when(spread, q[3] + FENCE * iqr).alias(f"__high{i}"),
        ]
    return kept(wide.select(*cols(by), *found))


def _at_fence(i: int, name: str) -> tuple[Column, Column]:
    """Conditions: at or below the lower, at or above the upper fence."""
    return number(name) <= col(f"__low{i}"), number(name) >= col(f"__high{i}")


def _fence_columns(variables: list[str]) -> list[str]:
    return [f"__{c}{i}" for i in range(len(variables)) for c in ("q", "low", "high")]


def _with_fences(
    df: DataFrame, fences: DataFrame, variables: list[str], by: list[str],
) -> DataFrame:
    taken = [c for c in _fence_columns(variables) if c in df.columns]
    if taken:
        raise ValueError(f"rename column(s) {taken}: the fences use these names")
    return with_stats(df, fences, by)


def outlier_summary(
    df: DataFrame, variables: ColumnNames, by: ColumnNames | None = None, *,
    approximate: bool = False, buffer_rows: int = SMALL_GROUP,
) -> DataFrame:
    """Quantiles, fences and outlier counts, one row per variable and group.

    The percentages are of all rows, those without a value included.
    """
    variables, by = names(variables), names(by)
    _refuse_outputs(by, ["var", *_QUANTILE_NAMES])
    fences = _fences(df, variables, by, approximate, buffer_rows)
    counts = []
    for i, name in enumerate(variables):
        below, above = _at_fence(i, name)
        counts += [F.count_if(below).alias(f"__below{i}"), F.count_if(above).alias(f"__above{i}")]
    narrow = df.select(*cols(by), *cols(variables))
    counted = (
        _with_fences(narrow, fences, variables, by)
        .groupBy(*cols(by)).agg(F.count("*").alias("__n"), *counts)
    )
    complete = with_stats(counted, fences, by)
    rows = F.array(*[_summary_row(i, name) for i, name in enumerate(variables)])
    listed = complete.select(*cols(by), F.inline(rows))
    measures = [c for c in listed.columns if c not in by and c != "var"]
    return listed.select("var", *cols(by), *measures)


def store_sketches(
    df: DataFrame, path: str, variables: ColumnNames, by: ColumnNames | None = None, *, part: str,
) -> None:
    """Write a quantile sketch of every variable, group and part to the folder ``path``.

    ``part`` names the column of what arrives as one, a day or a file.  The parts that ``df`` holds
    replace those in the folder, all others stay; so new data costs its own scan only.
    """
    variables, by = names(variables), names(by)
    require(df, part, *by)
    require_number(df, *variables)
    write_sketches(df, path, variables, by, part)


def outlier_summary_from_sketches(
    df: DataFrame, path: str, variables: ColumnNames, by: ColumnNames | None = None, *,
    buffer_rows: int = SMALL_GROUP,
) -> DataFrame:
    """:func:`outlier_summary` in one scan of ``df``, with the sketches that ``path`` holds of it.

    The result is the same, exact.  Sketches that don't belong to ``df`` stop the job, as a
    quantile then lies outside its bracket.
    """
    variables, by = names(variables), names(by)
    _refuse_outputs(by, ["var", *_QUANTILE_NAMES])
    require(df, *by)
    require_number(df, *variables)
    cells, keys = summary_cells(df, path, variables, by, FENCE, buffer_rows)
    found = quantiles_of_cells(cells, keys, FIVE_NUMBERS)
    q = F.col("quantiles")
    spread, iqr = q[0] != q[4], q[3] - q[1]
    fences = found.select(
        *keys, F.when(spread, q).alias("__q"), F.when(spread, q[1] - FENCE * iqr).alias("__low"),
        F.when(spread, q[3] + FENCE * iqr).alias("__high"))
    # A cell of several values lies on one side of a fence, as its bracket has cells of one value.
    below, above = F.col("last") <= F.col("__low"), F.col("first") >= F.col("__high")
    counted = with_stats(cells, kept(fences), keys).groupBy(*keys).agg(
        F.sum("rows").alias("__n"), F.first("__q").alias("__q"),
        *[F.first(c).alias(c) for c in ("__low", "__high")],
        *[F.sum(F.when(side, F.col("held")).otherwise(0)).alias(name)
          for side, name in ((below, "__below"), (above, "__above"))])
    n = F.col("__n").cast("double")
    label = F.get(F.array(*[F.lit(v) for v in variables]), F.col("variable"))
    return counted.select(
        label.alias("var"), *[F.col(k).alias(b) for k, b in zip(keys, by)],
        *[F.col("__q")[k].alias(name) for k, name in enumerate(_QUANTILE_NAMES)],
        F.col("__low").alias("lower_outlier_threshold"),
        F.col("__below").alias("lower_outlier_count"),
        divide(F.col("__below"), n).alias("lower_outlier_pct"),
        F.col("__high").alias("upper_outlier_threshold"),
        F.col("__above").alias("upper_outlier_count"),
        divide(F.col("__above"), n).alias("upper_outlier_pct"))


def _summary_row(i: int, name: str) -> Column:
    n = F.col("__n").cast("double")
    return F.struct(
        F.lit(name).alias("var"),
        *[col(f"__q{i}")[k].alias(q) for k, q in enumerate(_QUANTILE_NAMES)],
        col(f"__low{i}").alias("lower_outlier_threshold"),
        col(f"__below{i}").alias("lower_outlier_count"),
        divide(col(f"__below{i}"), n).alias("lower_outlier_pct"),
        col(f"__high{i}").alias("upper_outlier_threshold"),
        col(f"__above{i}").alias("upper_outlier_count"),
        divide(col(f"__above{i}"), n).alias("upper_outlier_pct"),
    )


def null_outliers(
    df: DataFrame, variables: ColumnNames, which: str, by: ColumnNames | None = None, *,
    approximate: bool = False, buffer_rows: int = SMALL_GROUP,
) -> DataFrame:
    """Every row, with the variables' outliers set to NULL and the rest as doubles.

    ``which`` is ``both``, ``upper`` or ``lower``.  Columns and their order stay.
    """
    if which not in SIDES:
        raise ValueError(f"which must be one of {SIDES}, not {which!r}")
    variables, by = names(variables), names(by)
    fences = _fences(df, variables, by, approximate, buffer_rows)

    def cleaned(i: int, name: str) -> Column:
        below, above = _at_fence(i, name)
        gone = {"both": below | above, "lower": below, "upper": above}[which]
        return F.when(gone, None).otherwise(number(name)).alias(name)

    place = {name: i for i, name in enumerate(variables)}
    return _with_fences(df, fences, variables, by).select([
        cleaned(place[c], c) if c in place else col(c) for c in df.columns
    ])


def flag_outliers(
    df: DataFrame, variables: ColumnNames, by: ColumnNames | None = None, *,
    approximate: bool = False, buffer_rows: int = SMALL_GROUP,
) -> DataFrame:
    """Every row, with 0/1 columns ``<variable>_lower_outlier_flag`` and ``_upper_``.

    A missing value is not an outlier.
    """
    variables, by = names(variables), names(by)
    fences = _fences(df, variables, by, approximate, buffer_rows)
    flags = []
    for i, name in enumerate(variables):
        below, above = _at_fence(i, name)
        flags += [
            F.when(below, 1).otherwise(0).alias(f"{name}_lower_outlier_flag"),
            F.when(above, 1).otherwise(0).alias(f"{name}_upper_outlier_flag"),
        ]
    return _with_fences(df, fences, variables, by).select(*cols(df.columns), *flags)


def outlier_histogram(
    df: DataFrame, variable: str, which: str = "both", *,
    bins: int = HISTOGRAM_BINS, approximate: bool = False, buffer_rows: int = SMALL_GROUP,
) -> DataFrame:
    """Histogram of a variable before and after its outliers are removed.

    Equal-width bins over each version's own range; only bins that hold rows
    appear.  Columns: ``version``, ``bin`` (from 0), ``bin_start``, ``bin_end``, ``n``.
    """
    both = F.array(
        F.struct(F.lit("before").alias("version"), F.col("before").alias("value")),
        F.struct(F.lit("after").alias("version"), F.col("after").alias("value")),
    )
    plain = df.select(number(variable).alias("before"), number(variable).alias("after"))
    cleaned = null_outliers(
        plain, "after", which, approximate=approximate, buffer_rows=buffer_rows)
    values = cleaned.select(F.inline(both)).filter(F.col("value").isNotNull())

    ranges = cleaned.agg(*[
        f(c).alias(f"{c}_{label}")
        for c in ("before", "after") for label, f in (("low", F.min), ("high", F.max))
    ])

    def of_version(label: str) -> Column:
        return F.when(F.col("version") == "before", col(f"before_{label}")).otherwise(
            col(f"after_{label}"))

    low, width = of_version("low"), (of_version("high") - of_version("low")) / bins
    slot = F.least(F.floor(divide(F.col("value") - low, width)), F.lit(bins - 1))
    binned = with_only_row(values, ranges).select(
        "version", low.alias("low"), width.alias("width"),
        F.coalesce(slot, F.lit(0)).cast("int").alias("bin"),
    )
    return (
        binned.groupBy("version", "low", "width", "bin").agg(F.count("*").alias("n"))
        .select(
            "version", "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
            "n",
        )
    )
