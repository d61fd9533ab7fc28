"""Small column helpers shared by every operator.

All of them are plain Spark SQL expressions, so they stay inside whole-stage
code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

ColumnNames = str | Sequence[str]


def quoted(name: str) -> str:
    """A column name as SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of exactly this name: dots and spaces are part of it."""
    return F.col(quoted(name))


def cols(columns: Iterable[str | Column]) -> list[Column]:
    """Columns of exactly these names; columns stay as they are."""
    return [col(c) if isinstance(c, str) else c for c in columns]


def names(columns: ColumnNames | None) -> list[str]:
    """One name, several names or nothing, as a list."""
    if columns is None:
        return []
    if isinstance(columns, str):
        return [columns]
    return list(columns)


def require(df: DataFrame, *columns: str | None) -> None:
    """Raise when a named column is missing from ``df``."""
    missing = [c for c in columns if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s) {missing}; the table has {df.columns}")


def require_number(df: DataFrame, *columns: str | None) -> None:
    """Raise when a named column is missing, or is neither a number nor a boolean."""
    require(df, *columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        c for c in columns
        if c is not None and not isinstance(kinds[c], (T.NumericType, T.BooleanType))
    ]
    if wrong:
        raise ValueError(f"column(s) {wrong} must be numeric or boolean")


def number(column: str | Column) -> Column:
    """The column as a double: booleans become 0/1, and NaN counts as missing."""
    value = (col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(value), value)


def divide(top: Column, bottom: Column) -> Column:
    """Division that gives NULL for a zero denominator (ANSI mode would stop the job)."""
    return F.try_divide(top, bottom)


def ratio(top: str, bottom: str) -> Column:
    """Row-wise ratio of two columns, NULL for a zero denominator."""
    return divide(number(top), number(bottom))


def weight_or_one(weight: str | None) -> Column:
    """The weight column, or 1 for every row when no weight is named; one below zero is an error."""
    if weight is None:
        return F.lit(1.0)
    refused = F.raise_error(F.lit(f"{weight} must not be below zero")).cast("double")
    return F.when(number(weight) < 0, refused).otherwise(number(weight))


def dummy(predicate: Column) -> Column:
    """1 where the predicate holds, 0 where it fails, NULL where it is unknown."""
    return F.when(predicate, 1).when(~predicate, 0)


def not_in(column: str | Column, values: Iterable) -> Column:
    """``NOT IN`` that keeps the rows whose value is missing."""
    value = col(column) if isinstance(column, str) else column
    return ~F.coalesce(value.isin(list(values)), F.lit(False))


def percent(value: str, digits: int = 1) -> str:
    """SQL text that writes a proportion: 0.1234 becomes ``12.3%``; NULL stays NULL."""
    rounded = f"round(({value}) * 100, {digits}) + 0D"
    return (f"CASE WHEN ({value}) IS NOT NULL THEN"
            f" concat(format_string('%.{digits}f', {rounded}), '%') END")


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every column renamed to ``prefix + name``, apart from those in ``keep``."""
    return df.select([
        col(c) if c in keep else col(c).alias(prefix + c) for c in df.columns
    ])


def checked_binary(column: str, value: Column, bad_rows: Column) -> Column:
    """``value``, or an error when any row held something else than 0, 1 or NULL.

    ``bad_rows`` is counted in the same aggregate as ``value``, so the check
    costs no scan of its own.
    """
    message = f"{column} must hold only 0, 1 or NULL"
    return F.when(bad_rows > 0, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def is_not_binary(value: Column) -> Column:
    """True for a value outside 0, 1 and NULL."""
    return value.isNotNull() & ~value.isin(0.0, 1.0)
