"""Design-based estimates: means, ratios and differences of means with their linearised errors,
stratified proportions and design totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    ColumnNames, checked_binary, col, cols, divide, is_not_binary, names, number, ratio, require,
    require_number, weight_or_one,
)
from ..functions.distributions import t_p_value, t_quantile
from ..functions.intervals import Z_95
from ..plans.attach import with_only_row
from ..plans.linearised import SurveyDesign, design_rows, design_variance


def _estimated(
    rows: DataFrame, whole: DataFrame, estimate: str, influence: Column, design: SurveyDesign,
) -> DataFrame:
    """The row of ``whole`` with units, strata and the standard error of ``estimate``."""
    variance = design_variance(with_only_row(rows, whole), {"__variance": influence}, design)
    return with_only_row(variance, whole).withColumn("std_error", F.sqrt("__variance")).select(
        *[c for c in whole.columns if c != estimate], "strata", "units", estimate, "std_error")


def _with_interval(df: DataFrame, estimate: str, level: float, lost: int = 0) -> DataFrame:
    """Add df (units less strata less ``lost``) and the t interval of ``estimate``."""
    df = df.withColumn("df", (F.col("units") - F.col("strata") - lost).cast("double"))
    reach = t_quantile((1 + level) / 2, F.col("df")) * F.col("std_error")
    df = df.withColumn("__reach", reach)
    return df.withColumns({
        "conf_int_lower": F.col(estimate) - F.col("__reach"),
        "conf_int_upper": F.col(estimate) + F.col("__reach")}).drop("__reach")


def survey_mean(
    df: DataFrame, value: str, design: SurveyDesign, *, where: Column | None = None,
    level: float | None = None,
) -> DataFrame:
    """Weighted mean with its linearised standard error; rows without value are left out.

    ``where`` names a subpopulation: the mean is taken over its rows, while all rows stay in the
    design.  A ``level`` adds the number of sampling units, the degrees of freedom (units
    less strata, both with rows in the subpopulation) and the t interval.  A stratum with one
    unit has no variance and stops the job with its name, unless the design says otherwise.
    """
    require_number(df, value)
    rows = design_rows(df, design, {"y": number(value)}, where)
    found = _mean(rows, design)
    if level is None:
        return found.select("n", "strata", "mean", "std_error")
    return _with_interval(found, "mean", level)


def _mean(rows: DataFrame, design: SurveyDesign) -> DataFrame:
    w, y = F.when(F.col("inside"), F.col("w")), F.col("y")
    whole = rows.agg(
        F.count_if("inside").alias("n"), F.sum(w).alias("__total"),
        divide(F.sum(w * y), F.sum(w)).alias("mean"),
    )
    influence = divide(F.col("w") * (y - F.col("mean")), F.col("__total"))
    return _estimated(rows, whole, "mean", influence, design).drop("__total")


def survey_ratio(
    df: DataFrame, top: str, bottom: str, design: SurveyDesign, *, of_rows: bool = False,
    where: Column | None = None, level: float = 0.95,
) -> DataFrame:
    """Ratio of two weighted totals with its linearised standard error and t interval.

    Rows without either value are left out.  ``of_rows`` takes the mean of the rows' own ratios
    instead; rows whose ``bottom`` is zero then have none.
    """
    require_number(df, top, bottom)
    if of_rows:
        rows = design_rows(df, design, {"y": ratio(top, bottom)}, where)
        found = _mean(rows, design).withColumnRenamed("mean", "ratio")
        return _with_interval(found, "ratio", level)
    rows = design_rows(df, design, {"y": number(top), "x": number(bottom)}, where)
    w, y, x = F.when(F.col("inside"), F.col("w")), F.col("y"), F.col("x")
    whole = rows.agg(
        F.count_if("inside").alias("n"), F.sum(w * x).alias("__total"),
        divide(F.sum(w * y), F.sum(w * x)).alias("ratio"),
    )
    influence = divide(F.col("w") * (y - F.col("ratio") * x), F.col("__total"))
    return _with_interval(
        _estimated(rows, whole, "ratio", influence, design).drop("__total"), "ratio", level)


def survey_t_test_by_design(
    df: DataFrame, value: str, group: str, x, y, design: SurveyDesign, *,
    where: Column | None = None, level: float = 0.95,
) -> DataFrame:
    """t test of the difference between two groups' means under a whole design.

    Reports the mean of the alphabetically later level minus the earlier one, on units less strata
    less one degrees of freedom.  The design is that of the two groups' rows with a value;
    rows outside the subpopulation ``where`` stay in it without influence.
    """
    require(df, group)
    require_number(df, value)
    if x == y:
        raise ValueError("the two samples need different levels")
    first, second = sorted((x, y))
    rows = design_rows(
        df.filter(col(group).isin(x, y)), design,
        {"y": number(value), "later": col(group) == F.lit(second)}, where)
    sides = {"first": F.col("inside") & ~F.col("later"), "second": F.col("inside") & F.col("later")}
    w, v = F.col("w"), F.col("y")
    whole = rows.agg(*[column for name, mine in sides.items() for column in (
        F.count_if(mine).alias(f"n_{name}"), F.sum(F.when(mine, w)).alias(f"__total_{name}"),
        divide(F.sum(F.when(mine, w * v)), F.sum(F.when(mine, w))).alias(f"mean_{name}"))])
    whole = whole.withColumn("diff_in_means", F.col("mean_second") - F.col("mean_first"))
    influence = F.when(
        F.col("later"), divide(w * (v - F.col("mean_second")), F.col("__total_second"))
    ).otherwise(-divide(w * (v - F.col("mean_first")), F.col("__total_first")))
    found = _estimated(rows, whole, "diff_in_means", influence, design)
    tested = _with_interval(found, "diff_in_means", level, lost=1).withColumn(
        "t_stat", divide(F.col("diff_in_means"), F.col("std_error"))).withColumn(
        "p_value", t_p_value(F.col("t_stat"), F.col("df")))
    return tested.select(
        "n_first", "n_second", "strata", "units", "mean_first", "mean_second", "diff_in_means",
        "std_error", "df", "t_stat", "p_value", "conf_int_lower", "conf_int_upper")


def strata_overview(
    df: DataFrame, design: SurveyDesign, outcome: str | None = None,
) -> DataFrame:
    """Sum of weights, number of strata and the unweighted share of an outcome.

    Rows without a stratum form one stratum together.
    """
    design.check(df)
    require(df, design.strata)
    require_number(df, outcome)
    stratum = col(design.strata) if design.strata else F.lit(1)
    hit = F.when(number(outcome) == 1, 1.0).otherwise(0.0) if outcome else F.lit(None)
    return df.agg(
        F.count("*").alias("n"), F.sum(weight_or_one(design.weight)).alias("sum_of_weights"),
        (F.count_distinct(stratum) + F.max(stratum.isNull().cast("int"))).alias("strata"),
        F.avg(hit.cast("double")).alias("unweighted_share"),
    )


def stratified_proportion(
    df: DataFrame, outcome: str, strata: ColumnNames, populations: DataFrame, population: str, *,
    z: float = Z_95,
) -> DataFrame:
    """Proportion's variance under stratified sampling without replacement.

    ``populations`` holds one row per stratum with its size in ``population``; a stratum that it
    lists twice, or with fewer than the sampled rows, stops the job with its name.
    Each stratum adds its variance, corrected for the finite population, times
    the square of its share of the sample.
    """
    parts, strata = _stratum_variances(df, outcome, names(strata), populations, population)
    n = F.sum("n_h").cast("double")
    weighted = F.sum(F.pow(F.col("n_h").cast("double"), 2) * F.col("variance_h"))
    return (
        parts.agg(
            F.sum("n_h").alias("n"), F.count("*").alias("strata"),
            divide(F.sum("x_h").cast("double"), n).alias("proportion"),
            divide(weighted, n * n).alias("variance"),
        )
        .withColumn("std_error", F.sqrt("variance"))
        .withColumn("margin_of_error", z * F.col("std_error"))
    )


def stratum_variances(
    df: DataFrame, outcome: str, strata: ColumnNames, populations: DataFrame, population: str,
) -> DataFrame:
    """Each stratum's rows, successes, population, proportion and variance."""
    parts, strata = _stratum_variances(df, outcome, names(strata), populations, population)
    return parts.select(
        *cols(strata), "n_h", "x_h", "population_h",
        divide(F.col("x_h").cast("double"), F.col("n_h")).alias("p_h"), "variance_h")


def _stratum_variances(
    df: DataFrame, outcome: str, strata: list[str], populations: DataFrame, population: str,
) -> tuple[DataFrame, list[str]]:
    require(df, *strata)
    require_number(df, outcome)
    require(populations, *strata)
    require_number(populations, population)
    y = number(outcome)
    sample = df.filter(y.isNotNull()).groupBy(*cols(strata)).agg(
        F.count("*").alias("n_h"), F.count_if(y == 1).alias("x_h"),
        F.count_if(is_not_binary(y)).alias("bad_rows"))
    of = [f"__of_{s}" for s in strata]
    sizes = populations.select(
        *[col(s).alias(o) for s, o in zip(strata, of)], number(population).alias("__size")
    ).groupBy(*cols(of)).agg(
        F.max("__size").alias("population_h"), F.count("*").alias("listed_h"))
    same = [col(s).eqNullSafe(col(f"__of_{s}")) for s in strata]
    joined = sample.join(sizes, same, "left").drop(*of)
    stratum = F.concat_ws(", ", *[F.coalesce(col(s).cast("string"), F.lit("NULL")) for s in strata])
    wrong = (
        F.when(F.col("listed_h") > 1, F.concat(F.lit("populations list a stratum twice: "), stratum))
        .when(F.col("population_h") < F.col("n_h"), F.concat(
            F.lit("population smaller than the sample in stratum: "), stratum)))
    p = divide(F.col("x_h").cast("double"), F.col("n_h"))
    size, n = F.col("population_h"), F.col("n_h").cast("double")
    variance = divide(p * (1 - p), n) * divide(size - n, size - 1)
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).otherwise(
        checked_binary(outcome, variance, F.col("bad_rows")))
    return joined.withColumn("variance_h", checked), strata
