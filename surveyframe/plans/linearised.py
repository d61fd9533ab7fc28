"""Variances under a survey design, from the influence of each row.

To first order, an estimate that is a smooth function of weighted totals moves with
the sum of its rows' influences (Taylor linearisation).  An operator states the
influence of a row as a column; what the design makes of it is the same for all of
them: influences add up to sampling units, units vary inside their stratum, and
strata add up.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, divide, number, require, require_number, weight_or_one

LONELY = ("fail", "remove", "adjust", "average")
NO_STRATA = "all rows"


@dataclass(frozen=True)
class SurveyDesign:
    """Columns that describe how the rows were sampled.

    ``unit`` names the sampling unit of a row inside its stratum (a cluster); without it each row
    is a unit of its own.  ``fpc`` holds the population size of the row's stratum, in units.
    ``lonely`` says what becomes of a stratum with a single unit, which has no spread: it stops the
    job (``fail``), adds nothing (``remove``), adds the square of the unit's influence
    (``adjust``), or as much as the other strata on average (``average``).
    """

    weight: str | None = None
    strata: str | None = None
    fpc: str | None = None
    unit: str | None = None
    lonely: str = "fail"

    def check(self, df: DataFrame) -> None:
        require(df, self.strata, self.unit)
        require_number(df, self.weight, self.fpc)
        if self.lonely not in LONELY:
            raise ValueError(f"lonely must be one of {LONELY}, not {self.lonely!r}")


def design_rows(
    df: DataFrame, design: SurveyDesign, values: Mapping[str, Column],
    where: Column | None = None,
) -> DataFrame:
    """(stratum, unit, population, w, inside, values): the rows that have a weight and all values.

    Rows outside the subpopulation ``where`` need no values: they stay in the design, with
    ``inside`` false and values of NULL, and must have no influence.
    """
    design.check(df)
    inside = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = df.select(
        (col(design.strata).cast("string") if design.strata else F.lit(NO_STRATA)).alias("stratum"),
        (_known_unit(design) if design.unit else F.lit(None).cast("string")).alias("unit"),
        (number(design.fpc) if design.fpc else F.lit(None).cast("double")).alias("population"),
        weight_or_one(design.weight).alias("w"), inside.alias("inside"),
        *[F.when(inside, value).alias(name) for name, value in values.items()])
    complete = F.col("w").isNotNull()
    for name in values:
        complete = complete & (~F.col("inside") | F.col(name).isNotNull())
    return rows.filter(complete)


def _known_unit(design: SurveyDesign) -> Column:
    missing = F.raise_error(F.lit(f"{design.unit}: a row names no sampling unit")).cast("string")
    return F.coalesce(col(design.unit).cast("string"), missing)


def _of_stratum(text: str) -> Column:
    return F.concat(F.lit(text + ": "), F.coalesce("stratum", F.lit("NULL")))


def design_variance(
    rows: DataFrame, influences: Mapping[str, Column], design: SurveyDesign,
) -> DataFrame:
    """One row: ``units`` and ``strata`` with a row in the subpopulation, and under each name
    the variance of the sum of that influence.

    Each stratum adds ``(1 - n / N) * n * variance of its units' sums``.  A stratum whose rows name
    different populations, or a population smaller than its sample, stops the job with
    its name, as does a single unit under ``lonely="fail"``.
    """
    names = list(influences)
    rows = rows.select(
        "stratum", "unit", "population", "inside",
        *[F.coalesce(F.when(F.col("inside"), z), F.lit(0.0)).alias(n)
          for n, z in influences.items()])
    if design.unit:
        rows = rows.groupBy("stratum", "unit").agg(
            F.min("population").alias("population"), F.max("population").alias("__most"),
            F.max("inside").alias("inside"), *[F.sum(n).alias(n) for n in names])
    else:
        rows = rows.withColumn("__most", F.col("population"))
    spreads = [f(n).alias(f"{a}_{n}") for n in names for a, f in (
        ("var", F.var_samp), ("sum", F.sum))]
    strata = rows.groupBy("stratum").agg(
        F.count("*").alias("n_h"), F.count_if("inside").alias("inside_h"),
        F.min("population").alias("least_h"), F.max("__most").alias("population_h"), *spreads)
    n, size = F.col("n_h"), F.col("population_h")
    wrong = (
        F.when(F.col("least_h") < size, _of_stratum("different population sizes in stratum"))
        .when(size < n, _of_stratum("population smaller than the sample in stratum")))
    if design.lonely == "fail":
        kind = "a single sampling unit in stratum" if design.unit else "stratum with a single row"
        wrong = wrong.when(n == 1, _of_stratum(kind))
    unsampled = F.coalesce(1 - divide(n.cast("double"), size), F.lit(1.0))
    parts = []
    for name in names:
        spread = unsampled * n * col(f"var_{name}")
        alone = {"adjust": unsampled * F.pow(col(f"sum_{name}"), 2),
                 "remove": F.lit(0.0)}.get(design.lonely, F.lit(None).cast("double"))
        part = F.when(n == 1, alone).otherwise(spread)
        parts.append(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double"))
                     .otherwise(part).alias(name))
    strata = strata.select("inside_h", *parts)
    totals = []
    for name in names:
        total = F.sum(name)
        if design.lonely == "average":  # strata without a value take the mean of the others
            total = divide(total * F.count("*"), F.count(name))
        totals.append(total.alias(name))
    return strata.agg(
        F.sum("inside_h").alias("units"), F.count_if(F.col("inside_h") > 0).alias("strata"),
        *totals)
