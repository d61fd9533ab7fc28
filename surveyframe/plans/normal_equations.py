"""Least squares with several regressors, from one aggregate over the rows.

A row has few regressors that are not zero, so its products are listed and added up by
their two places: the sums of a factor with many levels cost no more per row than those of
one with few.  The sums are one small row, and a Cholesky factorisation in column
expressions solves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A column counts as a combination of those before it when so little of its square is left.
ALIASED = 1e-10


def gram(rows: DataFrame, places: int) -> DataFrame:
    """One row (n, gram): the sums of products of the entries of every row.

    ``rows`` has ``w`` and ``entries``, an array of (place, value) without zeros, in ascending
    order; ``gram`` is an array of ``places`` rows, each up to its diagonal.
    """
    entry, other = F.col("entry"), F.col("other")
    one = rows.select("w", "entries", F.explode("entries").alias("entry"))
    pairs = one.select("w", "entry", F.explode("entries").alias("other")).filter(
        F.col("other.place") <= F.col("entry.place"))
    sums = pairs.groupBy(entry["place"].alias("i"), other["place"].alias("j")).agg(
        F.sum(F.col("w") * entry["value"] * other["value"]).alias("s"), F.count("*").alias("n"))
    held = F.map_from_entries(F.collect_list(F.struct(
        (F.col("i") * places + F.col("j")).alias("place"), F.col("s").alias("s"))))

    def row(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), i), lambda j: F.coalesce(
            F.try_element_at(F.col("held"), i * places + j), F.lit(0.0)))

    numbers = F.sequence(F.lit(0), F.lit(places - 1))
    # The first place is 1 in every row, so its square counts the rows.
    return sums.agg(
        F.coalesce(F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("n"))),
                   F.lit(0)).alias("n"),
        held.alias("held")).select("n", F.transform(numbers, row).alias("gram"))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def _empty(kind: str) -> Column:
    return F.expr(f"CAST(array() AS {kind})")


def cholesky(gram_rows: Column, size: int) -> Column:
    """Rows of the lower triangle L with L L' = gram; an aliased column has a diagonal of 0."""

    def added(lower: Column, k: Column) -> Column:
        wanted = F.get(gram_rows, k)

        def next_one(row: Column, above: Column) -> Column:
            j = F.size(row)
            diagonal = F.element_at(above, -1)
            left = F.get(wanted, j) - _dot(row, F.slice(above, 1, j))
            return F.concat(row, F.array(F.when(diagonal > 0, left / diagonal).otherwise(0.0)))

        def closed(row: Column) -> Column:
            square = F.element_at(wanted, -1)
            left = square - _dot(row, row)
            return F.concat(row, F.array(
                F.when(left > ALIASED * square, F.sqrt(F.greatest(left, F.lit(0.0)))).otherwise(0.0)))

        row = F.aggregate(lower, _empty("array<double>"), next_one, closed)
        return F.concat(lower, F.array(row))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(size - 1)), _empty("array<array<double>>"), added)


def inverse(lower: Column, size: int) -> Column:
    """Rows of the inverse of L, whole; an aliased row and column is 0."""
    numbers = F.sequence(F.lit(0), F.lit(size - 1))

    def added(found: Column, row: Column) -> Column:
        k = F.size(found)
        diagonal = F.element_at(row, -1)
        factors = F.slice(row, 1, k)

        def entry(i: Column) -> Column:
            above = F.transform(found, lambda r: F.get(r, i))
            start = F.when(i == k, 1.0).otherwise(0.0)
            return F.when(diagonal > 0, (start - _dot(factors, above)) / diagonal).otherwise(0.0)

        return F.concat(found, F.array(F.transform(numbers, entry)))

    return F.aggregate(lower, _empty("array<array<double>>"), added)
