"""Tests of the difference between two means.

Every test names its two samples as levels of a grouping column and reports
``mean of x - mean of y``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    ColumnNames, col, cols, divide, names, number, require, require_number, weight_or_one,
)
from ..functions.distributions import t_p_value, t_quantile, t_quantile_by_row
from ..plans.two_samples import two_sample_moments
from .regression import linear_regression

DF_RULES = ("welch", "pooled", "conservative")

# Fixed values of the test_type column.
UNWEIGHTED_TEST = "t.test"
WEIGHTED_TEST = "wtd.t.test"


# --- shared arithmetic -------------------------------------------------------

def _standard_error(v1: Column, v2: Column, n1: Column, n2: Column, pooled: bool) -> Column:
    if not pooled:
        return F.sqrt(divide(v1, n1) + divide(v2, n2))
    common = divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    return F.sqrt(common * (divide(F.lit(1.0), n1) + divide(F.lit(1.0), n2)))


def _degrees_of_freedom(v1: Column, v2: Column, n1: Column, n2: Column, rule: str) -> Column:
    if rule == "pooled":
        return n1 + n2 - 2
    if rule == "conservative":
        return F.least(n1, n2) - 1
    part1, part2 = divide(v1, n1), divide(v2, n2)
    return divide(
        F.pow(part1 + part2, 2),
        divide(part1 * part1, n1 - 1) + divide(part2 * part2, n2 - 1),
    )


def _with_t(df: DataFrame, null_difference: float = 0.0) -> DataFrame:
    """Add t_stat and p_value to columns diff_in_means, std_error and df."""
    t = divide(F.col("diff_in_means") - null_difference, F.col("std_error"))
    return df.withColumn("t_stat", t).withColumn(
        "p_value", t_p_value(F.col("t_stat"), F.col("df")))


def _with_interval(df: DataFrame, level: float | Column) -> DataFrame:
    """Add the t interval of diff_in_means; as a column the level differs by row."""
    if isinstance(level, Column):
        quantile = t_quantile_by_row((1 + level) / 2, F.col("df"))
    else:
        quantile = t_quantile((1 + level) / 2, F.col("df"))
    reach = quantile * F.col("std_error")
    return (
        df.withColumn("__reach", reach)
        .withColumn("conf_int_lower", F.col("diff_in_means") - F.col("__reach"))
        .withColumn("conf_int_upper", F.col("diff_in_means") + F.col("__reach"))
        .drop("__reach")
    )


def _tested(
    df: DataFrame, m1: Column, m2: Column, v1: Column, v2: Column, n1: Column, n2: Column,
    rule: str, level: float | Column, null_difference: float = 0.0,
) -> DataFrame:
    if rule not in DF_RULES:
        raise ValueError(f"df_rule must be one of {DF_RULES}, not {rule!r}")
    n1, n2 = n1.cast("double"), n2.cast("double")
    started = df.withColumns({
        "diff_in_means": m1 - m2,
        "std_error": _standard_error(v1, v2, n1, n2, rule == "pooled"),
        "df": _degrees_of_freedom(v1, v2, n1, n2, rule),
    })
    return _with_interval(_with_t(started, null_difference), level)


_TEST_COLUMNS = [
    "diff_in_means", "std_error", "df", "t_stat", "p_value", "conf_int_lower", "conf_int_upper",
]


# --- unweighted --------------------------------------------------------------

def t_test(
    df: DataFrame, value: str, group: str, order: Sequence, *,
    df_rule: str = "welch", level: float = 0.95,
) -> DataFrame:
    """Two-sample t test; ``order`` gives the two levels, first minus second.

    ``df_rule`` is ``welch``, ``pooled`` (equal variances) or ``conservative``
    (smaller sample size minus one).  Missing values are left out and counted.
    """
    x, y = order
    moments = two_sample_moments(df, [value], group, x, y)
    tested = _tested(
        moments, F.col("x_mean"), F.col("y_mean"), F.col("x_var"), F.col("y_var"),
        F.col("x_n"), F.col("y_n"), df_rule, level,
    )
    return tested.select(
        F.col("x_n").alias("n_x"), F.col("y_n").alias("n_y"),
        F.col("x_mean").alias("mean_x"), F.col("y_mean").alias("mean_y"), *_TEST_COLUMNS,
    )


def welch_t_test(
    df: DataFrame, value: str, group: str, x, y, *, level: float = 0.95,
) -> DataFrame:
    """Welch's t test with Welch-Satterthwaite degrees of freedom."""
    return t_test(df, value, group, (x, y), level=level)


def pooled_t_test(
    df: DataFrame, value: str, group: str, x, y, *, level: float = 0.95,
) -> DataFrame:
    """Student's t test with a common variance."""
    return t_test(df, value, group, (x, y), df_rule="pooled", level=level)


def t_test_from_summary(
    df: DataFrame, m1: str, m2: str, s1: str, s2: str, n1: str, n2: str, *,
    null_difference: float = 0.0, equal_variance: bool = False,
    df_rule: str | None = None, level: float | str = 0.95,
) -> DataFrame:
    """A t test on every row of a table of means, standard deviations and counts.

    ``level`` is a number, or names a column with the level of each row's interval; a row whose level
    is missing or not between 0 and 1 has no interval.
    """
    require_number(df, m1, m2, s1, s2, n1, n2, level if isinstance(level, str) else None)
    if isinstance(level, str):
        level = number(level)
    rule = df_rule or ("pooled" if equal_variance else "welch")
    taken = [c for c in _TEST_COLUMNS if c in df.columns]
    if taken:
        raise ValueError(f"the table already has column(s) {taken}")
    return _tested(
        df, col(m1).cast("double"), col(m2).cast("double"),
        F.pow(col(s1), 2), F.pow(col(s2), 2), col(n1), col(n2),
        rule, level, null_difference,
    )


# --- weighted ----------------------------------------------------------------

def _weighted_size(side: str, mean_one: bool) -> Column:
    """Sample size of the weighted test: rows, or the sum of the weights."""
    return col(f"{side}_wn").cast("double") if mean_one else col(f"{side}_wsum")


def _weighted_variance(side: str, mean_one: bool) -> Column:
    size = _weighted_size(side, mean_one)
    return divide(divide(col(f"{side}_wspread"), col(f"{side}_wsum")) * size, size - 1)


def weighted_t_test(
    df: DataFrame, value: str, group: str, x, y, weight: str, *,
    mean_one: bool = True, level: float = 0.95,
) -> DataFrame:
    """Welch test on weighted means.

    With ``mean_one`` the weights are statistical: they are rescaled to mean 1,
    so the sample size is the number of rows.  Without it they count
    observations and the sample size is their sum.
    """
    moments = two_sample_moments(df, [value], group, x, y, weight)
    sized = moments.select(
        _weighted_size("x", mean_one).alias("n_x"), _weighted_size("y", mean_one).alias("n_y"),
        F.col("x_wmean").alias("mean_x"), F.col("y_wmean").alias("mean_y"),
        _weighted_variance("x", mean_one).alias("x_wvar"),
        _weighted_variance("y", mean_one).alias("y_wvar"),
    )
    tested = _tested(
        sized, F.col("mean_x"), F.col("mean_y"), F.col("x_wvar"), F.col("y_wvar"),
        F.col("n_x"), F.col("n_y"), "welch", level,
    )
    return tested.select("n_x", "n_y", "mean_x", "mean_y", *_TEST_COLUMNS)


def survey_t_test(
    df: DataFrame, value: str, group: str, x, y, weight: str, *, level: float = 0.95,
) -> DataFrame:
    """Design-based t test: linearised variance, n - 2 degrees of freedom.

    Reports the mean of the alphabetically later level minus the earlier one.
    """
    first, second = sorted((x, y))
    moments = two_sample_moments(df, [value], group, first, second, weight)
    return _survey_tested(moments, F.col("y_wmean") - F.col("x_wmean"), level).select(
        F.col("x_wn").alias("n_first"), F.col("y_wn").alias("n_second"),
        F.col("x_wmean").alias("mean_first"), F.col("y_wmean").alias("mean_second"),
        *_TEST_COLUMNS,
    )


def _survey_tested(moments: DataFrame, difference: Column, level: float) -> DataFrame:
    n = (F.col("x_wn") + F.col("y_wn")).cast("double")
    scores = sum(
        (divide(col(f"{s}_wscore"), F.pow(col(f"{s}_wsum"), 2)) for s in ("x", "y")),
        F.lit(0.0),
    )
    started = moments.withColumns({
        "diff_in_means": difference,
        "std_error": F.sqrt(divide(n, n - 1) * scores),
        "df": n - 2,
    })
    return _with_interval(_with_t(started), level)


# --- dispatching test, one or many variables ---------------------------------

_MEANS_COLUMNS = [
    "x_unweighted_count", "x_na_count", "y_unweighted_count", "y_na_count",
    "mean_x", "mean_y", "diff_in_means", "weights_x_used", "weights_y_used", "test_type",
    "t_stat", "p_value", "std_error", "equal_variance", "conf_int_lower", "conf_int_upper",
]


def means_of_variables(
    df: DataFrame, variables: ColumnNames, group: str, x, y, *,
    weight: str | None = None, weights_are_statistical: bool = True,
    equal_variance: bool = False,
) -> DataFrame:
    """Test every variable's difference in means, one row each, in one pass.

    Where all weights of each sample are equal, or none are given, this is the
    unweighted t test with its t interval; otherwise the weighted Welch test
    with an interval of two standard errors.  ``variable_index`` is the place of
    the variable in the argument.
    """
    variables = names(variables)
    moments = two_sample_moments(df, variables, group, x, y, weight)
    if weight:
        plain = F.col("x_flat") & F.col("y_flat")
        used = {s: ~col(f"{s}_flat") for s in ("x", "y")}
    else:
        plain = F.lit(True)
        used = {s: F.lit(False) for s in ("x", "y")}

    def pick(unweighted: Column, weighted) -> Column:
        return F.when(plain, unweighted).otherwise(weighted()) if weight else unweighted

    chosen = moments.withColumns({
        "plain": plain,
        **{f"{s}_size": pick(col(f"{s}_n").cast("double"),
                             lambda s=s: _weighted_size(s, weights_are_statistical))
           for s in ("x", "y")},
        **{f"mean_{s}": pick(col(f"{s}_mean"), lambda s=s: col(f"{s}_wmean"))
           for s in ("x", "y")},
        **{f"{s}_spread": pick(col(f"{s}_var"),
                               lambda s=s: _weighted_variance(s, weights_are_statistical))
           for s in ("x", "y")},
    })
    parts = [col(c) for c in ("x_spread", "y_spread", "x_size", "y_size")]
    pooled = F.col("plain") & F.lit(equal_variance)
    tested = _with_t(chosen.withColumns({
        "diff_in_means": F.col("mean_x") - F.col("mean_y"),
        "std_error": F.when(pooled, _standard_error(*parts, True))
            .otherwise(_standard_error(*parts, False)),
        "df": F.when(pooled, _degrees_of_freedom(*parts, "pooled"))
            .otherwise(_degrees_of_freedom(*parts, "welch")),
    }))
    multiplier = F.when(F.col("plain"), t_quantile(0.975, F.col("df"))).otherwise(2.0)
    return (
        tested
        .withColumn("reach", multiplier * F.col("std_error"))
        .select(
            "variable_index", "variable",
            F.col("x_n").alias("x_unweighted_count"), F.col("x_missing").alias("x_na_count"),
            F.col("y_n").alias("y_unweighted_count"), F.col("y_missing").alias("y_na_count"),
            "mean_x", "mean_y", "diff_in_means",
            used["x"].alias("weights_x_used"), used["y"].alias("weights_y_used"),
            F.when(F.col("plain"), UNWEIGHTED_TEST).otherwise(WEIGHTED_TEST).alias("test_type"),
            "t_stat", "p_value", "std_error",
            pooled.alias("equal_variance"),
            (F.col("diff_in_means") - F.col("reach")).alias("conf_int_lower"),
            (F.col("diff_in_means") + F.col("reach")).alias("conf_int_upper"),
        )
    )


def two_sample_means(df: DataFrame, value: str, group: str, x, y, **options) -> DataFrame:
    """:func:`means_of_variables` for a single variable, without its name."""
    return means_of_variables(df, [value], group, x, y, **options).select(_MEANS_COLUMNS)


def means_of_two_tables(
    x_table: DataFrame, y_table: DataFrame, variables: ColumnNames, *,
    x_weight: str | None = None, y_weight: str | None = None, **options,
) -> DataFrame:
    """:func:`means_of_variables` for two samples that lie in two tables.

    Either weight may be missing; that sample then weighs 1 per row.
    """
    variables = names(variables)
    weight = "__weight" if x_weight or y_weight else None

    def narrowed(table: DataFrame, own: str | None, label: str) -> DataFrame:
        require(table, *variables)
        require_number(table, own)
        extra = [(col(own).cast("double") if own else F.lit(1.0)).alias(weight)] if weight else []
        return table.select(*cols(variables), *extra, F.lit(label).alias("__sample"))

    both = narrowed(x_table, x_weight, "x").unionByName(narrowed(y_table, y_weight, "y"))
    return means_of_variables(both, variables, "__sample", "x", "y", weight=weight, **options)


# --- the methods side by side ------------------------------------------------

def compare_mean_tests(
    df: DataFrame, value: str, group: str, x, y, weight: str, *, level: float = 0.95,
) -> DataFrame:
    """Welch, pooled, regression, weighted and design-based tests of the same difference.

    One row per ``method``, all as mean of x minus mean of y.  ``weighted`` takes
    the weights as statistical, ``weighted_sum_n`` as counts of observations.  The
    regressions on a dummy, ``ols`` and with weights ``wls``, are fitted on their
    own sums; the first five share those of the weighted moments.
    """
    moments = two_sample_moments(df, [value], group, x, y, weight)
    methods = _with_interval(_with_t(differences_by_method(moments)), level)
    dummy = F.when(col(group) == F.lit(x), 1.0).otherwise(0.0).alias("__is_x")
    rows = df.filter(col(group).isin(x, y)).select(
        number(value).alias("__value"), weight_or_one(weight).alias("__weight"), dummy)
    return methods.unionByName(_regressed(rows, None, level, "ols")).unionByName(
        _regressed(rows, "__weight", level, "wls"))


def differences_by_method(moments: DataFrame) -> DataFrame:
    """The difference, its error and degrees of freedom by each method, from the moments."""
    def side(name: str) -> Column:
        return F.col(name).cast("double")

    def row(method: str, m1, m2, v1, v2, n1, n2, rule: str) -> Column:
        return F.struct(
            F.lit(method).alias("method"), (m1 - m2).alias("diff_in_means"),
            _standard_error(v1, v2, n1, n2, rule == "pooled").alias("std_error"),
            _degrees_of_freedom(v1, v2, n1, n2, rule).alias("df"),
        )

    plain = [side(c) for c in ("x_mean", "y_mean", "x_var", "y_var", "x_n", "y_n")]

    def weighted(mean_one: bool) -> list[Column]:
        return [side("x_wmean"), side("y_wmean"), *[
            f(s, mean_one) for f in (_weighted_variance, _weighted_size) for s in ("x", "y")]]

    n = side("x_wn") + side("y_wn")
    scores = sum(
        (divide(F.col(f"{s}_wscore"), F.pow(F.col(f"{s}_wsum"), 2)) for s in ("x", "y")),
        F.lit(0.0),
    )
    survey = F.struct(
        F.lit("survey").alias("method"),
        (F.col("x_wmean") - F.col("y_wmean")).alias("diff_in_means"),
        F.sqrt(divide(n, n - 1) * scores).alias("std_error"), (n - 2).alias("df"),
    )
    return moments.select(F.inline(F.array(
        row("welch", *plain, "welch"), row("pooled", *plain, "pooled"),
        row("weighted", *weighted(True), "welch"),
        row("weighted_sum_n", *weighted(False), "welch"), survey,
    )))


def _regressed(rows: DataFrame, weight: str | None, level: float, method: str) -> DataFrame:
    """The slope of ``__value`` on ``__is_x`` as a row of the comparison."""
    terms = linear_regression(rows, "__value", "__is_x", weight=weight, level=level)
    return terms.filter(F.col("term") == "__is_x").select(
        F.lit(method).alias("method"), F.col("estimate").alias("diff_in_means"), "std_error",
        "df", F.col("statistic").alias("t_stat"), "p_value", "conf_int_lower", "conf_int_upper")
