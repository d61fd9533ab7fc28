"""Estimates, intervals and tests of proportions.

The outcome is a column of 0, 1 and NULL (or a boolean).  Estimates count all
rows of a group; the two-sample tests leave rows without an outcome out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    ColumnNames, checked_binary, col, cols, divide, is_not_binary, names, number, quoted, require,
    require_number, weight_or_one,
)
from ..functions.distributions import (
    chi_squared_p_value, normal_quantile, t_p_value, t_quantile,
)
from ..functions.intervals import (
    Z_95, coefficient_of_variation, newcombe, sample_size, standard_error_of_interval,
    wald_margin, wilson,
)
from ..functions.reliability import publication_flags
from ..plans.proportion_sums import checked, proportion_sums
from ..plans.two_samples import two_sample_moments
from .means import differences_by_method


# --- one proportion per group ------------------------------------------------

def grouped_proportions(
    df: DataFrame, outcome: str, by: ColumnNames | None = None, *, weight: str | None = None,
) -> DataFrame:
    """Rows, successes and proportion per group, weighted and plain."""
    by = names(by)
    require(df, *by)
    require_number(df, outcome, weight)
    sums = df.groupBy(*cols(by)).agg(*proportion_sums(outcome, weight))
    return (
        sums.withColumn("n_weighted", checked(outcome))
        .select(
            *cols(by), "n_weighted", "n_unweighted", "x_weighted", "x_unweighted",
            divide(F.col("x_weighted"), F.col("n_weighted")).alias("p_weighted"),
            divide(F.col("x_unweighted").cast("double"), F.col("n_unweighted"))
            .alias("p_unweighted"),
        )
    )


def wilson_intervals(
    df: DataFrame, outcome: str, by: ColumnNames | None = None, *,
    weight: str | None = None, z: float = Z_95,
) -> DataFrame:
    """Wilson score interval of each group's (weighted) proportion."""
    counted = grouped_proportions(df, outcome, by, weight=weight)
    lower, upper = wilson("n_weighted", "p_weighted", z)
    return counted.withColumns({"conf_int_lower": lower, "conf_int_upper": upper})


def proportion_cv(
    df: DataFrame, outcome: str, by: ColumnNames | None = None, *,
    weight: str | None = None, z: float = Z_95,
) -> DataFrame:
    """Wilson interval with the standard error and variation it implies."""
    return (
        wilson_intervals(df, outcome, by, weight=weight, z=z)
        .withColumn("standard_error", standard_error_of_interval(
            "conf_int_lower", "conf_int_upper"))
        .withColumn("coeff_of_variation", coefficient_of_variation(
            "standard_error", "p_weighted"))
    )


def suppression_flags(
    df: DataFrame, outcome: str, by: ColumnNames | None = None, *,
    weight: str | None = None, z: float = Z_95,
    strict: bool = True, confidential: bool = True, kind: str = "sample",
) -> DataFrame:
    """Each group's proportion with its unreliable and suppressed flags."""
    suppressed, unreliable = publication_flags(
        "x_unweighted", "n_unweighted", "coeff_of_variation",
        strict=strict, confidential=confidential, kind=kind,
    )
    return proportion_cv(df, outcome, by, weight=weight, z=z).withColumns({
        "unreliable_flag": unreliable, "suppressed_flag": suppressed})


def suppression_flags_by_rules(
    df: DataFrame, outcome: str, rules: Mapping[str, Mapping], by: ColumnNames | None = None, *,
    weight: str | None = None, z: float = Z_95,
) -> DataFrame:
    """Each group's proportion with its flags under several sets of rules, from one aggregate.

    ``rules`` maps a name to the options of :func:`suppression_flags`; its flags are
    ``<name>_suppressed`` and ``<name>_unreliable``.
    """
    flags = {}
    for name, options in rules.items():
        suppressed, unreliable = publication_flags(
            "x_unweighted", "n_unweighted", "coeff_of_variation",
            **({"strict": True, "confidential": True, "kind": "sample"} | dict(options)))
        flags |= {f"{name}_suppressed": suppressed, f"{name}_unreliable": unreliable}
    return proportion_cv(df, outcome, by, weight=weight, z=z).withColumns(flags)


def margin_of_error(
    df: DataFrame, outcome: str, by: ColumnNames | None = None, *,
    level: float = 0.95, z: float | None = None,
) -> DataFrame:
    """Wald standard error, margin and interval per group, over answered rows."""
    by = names(by)
    require(df, *by)
    require_number(df, outcome)
    y = number(outcome)
    counted = df.groupBy(*cols(by)).agg(
        F.count(y).alias("n"), F.count_if(y == 1).alias("successes"),
        F.count_if(is_not_binary(y)).alias("bad_rows"),
    )
    n, p = F.col("n").cast("double"), F.col("proportion")
    return (
        counted
        .withColumn("proportion", checked_binary(
            outcome, divide(F.col("successes").cast("double"), F.col("n")), F.col("bad_rows")))
        .withColumn("std_error", F.sqrt(divide(p * (1 - p), n)))
        .withColumn("margin_of_error", wald_margin("n", "proportion", level, z))
        .select(
            *cols(by), "n", "successes", "proportion", "std_error", "margin_of_error",
            (p - F.col("margin_of_error")).alias("conf_int_lower"),
            (p + F.col("margin_of_error")).alias("conf_int_upper"),
        )
    )


def required_sample_size(
    df: DataFrame, outcome: str, by: ColumnNames | None = None, *,
    margin: float = 0.05, z: float = Z_95,
) -> DataFrame:
    """Rows each group would need to have its proportion within ``margin``."""
    by = names(by)
    found = margin_of_error(df, outcome, by)
    return found.select(
        *cols(by), "n", "proportion",
        sample_size("proportion", margin, z).alias("required_sample_size"),
    )


# --- two proportions ---------------------------------------------------------

def _two_groups(
    df: DataFrame, outcome: str, group: str, x, y, weight: str | None, by: list[str],
) -> DataFrame:
    """Per ``by``: rows, weights, successes and proportions of the two levels."""
    require(df, group, *by)
    require_number(df, outcome, weight)
    value = number(outcome)
    rows = (
        df.filter(col(group).isin(x, y))
        .select(*cols(by), (col(group) == F.lit(x)).alias("is_x"), value.alias("hit"),
                weight_or_one(weight).alias("w"))
        .filter(F.col("hit").isNotNull())
    )
    sums = []
    for side, here in (("x", F.col("is_x")), ("y", ~F.col("is_x"))):
        sums += [
            F.count_if(here).alias(f"n_{side}"),
            F.sum(F.when(here, F.col("w"))).alias(f"weight_{side}"),
            F.sum(F.when(here & (F.col("hit") == 1), F.col("w"))).alias(f"hits_{side}"),
        ]
    counted = rows.groupBy(*cols(by)).agg(
        *sums, F.count_if(is_not_binary(F.col("hit"))).alias("bad_rows"))
    proportions = {
        f"p_{s}": divide(F.coalesce(col(f"hits_{s}"), F.lit(0.0)), col(f"weight_{s}"))
        for s in ("x", "y")
    }
    return counted.withColumn(
        "weight_x", checked_binary(outcome, F.col("weight_x"), F.col("bad_rows"))
    ).withColumns(proportions)


def two_proportion_test(
    df: DataFrame, outcome: str, group: str, x, y, *,
    weight: str | None = None, level: float = 0.95,
) -> DataFrame:
    """Pooled two-proportion t test.

    With a weight the proportions are weighted, while the sample sizes stay the
    numbers of rows.
    """
    counted = _two_groups(df, outcome, group, x, y, weight, [])
    hits = F.coalesce(F.col("hits_x"), F.lit(0.0)) + F.coalesce(F.col("hits_y"), F.lit(0.0))
    n_x, n_y = F.col("n_x").cast("double"), F.col("n_y").cast("double")
    pooled, df_col = F.col("pooled_p"), F.col("df")
    spread = pooled * (1 - pooled) * (divide(F.lit(1.0), n_x) + divide(F.lit(1.0), n_y))
    return (
        counted
        .withColumn("pooled_p", divide(hits, F.col("weight_x") + F.col("weight_y")))
        .withColumns({
            "p_diff": F.col("p_x") - F.col("p_y"),
            "std_error": F.sqrt(spread),
            "df": n_x + n_y - 2,
        })
        .withColumn("t_stat", divide(F.col("p_diff"), F.col("std_error")))
        .withColumn("p_value", t_p_value(F.col("t_stat"), df_col))
        .withColumn("reach", t_quantile((1 + level) / 2, df_col) * F.col("std_error"))
        .select(
            "n_x", "n_y", "p_x", "p_y", "pooled_p", "p_diff", "std_error", "df",
            "t_stat", "p_value",
            (F.col("p_diff") - F.col("reach")).alias("conf_int_lower"),
            (F.col("p_diff") + F.col("reach")).alias("conf_int_upper"),
        )
    )


def prop_test(
    df: DataFrame, outcome: str, group: str, x, y, *,
    weight: str | None = None, yates: bool = True, level: float = 0.95,
) -> DataFrame:
    """Chi-squared test that two proportions are equal, with or without Yates.

    With a weight, the sums of the weights stand for the counts.
    """
    counted = _two_groups(df, outcome, group, x, y, weight, [])
    tested = _equality_tested(counted, "weight_x", "weight_y", "p_x", "p_y", yates, level)
    return tested.select(
        F.col("weight_x").alias("n_x"), F.col("weight_y").alias("n_y"), "p_x", "p_y",
        *_EQUALITY_COLUMNS)


_EQUALITY_COLUMNS = ["p_diff", "statistic", "p_value", "conf_int_lower", "conf_int_upper"]


def _equality_parts(
    n_x: Column, n_y: Column, p_x: Column, p_y: Column, yates: bool, z: float,
) -> tuple[Column, Column]:
    """The chi-squared statistic of two proportions and the reach of their difference's interval."""
    delta = p_x - p_y
    inverse = divide(F.lit(1.0), n_x) + divide(F.lit(1.0), n_y)
    pooled = divide(p_x * n_x + p_y * n_y, n_x + n_y)
    correction = F.least(F.lit(0.5), divide(F.abs(delta), inverse)) if yates else F.lit(0.0)
    shift = correction * inverse
    separate = divide(p_x * (1 - p_x), n_x) + divide(p_y * (1 - p_y), n_y)
    statistic = divide(F.pow(F.abs(delta) - shift, 2), pooled * (1 - pooled) * inverse)
    return statistic, z * F.sqrt(separate) + shift


def _equality_tested(
    df: DataFrame, n_x: str, n_y: str, p_x: str, p_y: str, yates: bool, level: float,
) -> DataFrame:
    """Add the columns of the chi-squared test of two proportions."""
    sides = [col(c).cast("double") for c in (n_x, n_y, p_x, p_y)]
    statistic, reach = _equality_parts(*sides, yates, normal_quantile((1 + level) / 2))
    delta = F.col("p_diff")
    return (
        df.withColumns({"p_diff": sides[2] - sides[3], "statistic": statistic, "__reach": reach})
        .withColumns({
            "p_value": chi_squared_p_value(F.col("statistic")),
            "conf_int_lower": F.when(
                delta.isNotNull(), F.greatest(delta - F.col("__reach"), F.lit(-1.0))),
            "conf_int_upper": F.when(
                delta.isNotNull(), F.least(delta + F.col("__reach"), F.lit(1.0))),
        }).drop("__reach")
    )


def prop_test_one_sample(
    df: DataFrame, outcome: str, by: ColumnNames | None = None, *,
    level: float = 0.95, yates: bool = True,
) -> DataFrame:
    """Test of a proportion against one half, with its score interval, per group."""
    by = names(by)
    counted = margin_of_error(df, outcome, by).select(*cols(by), "n", "successes", "proportion")
    return _half_tested(counted, "successes", "n", level, yates)


_HALF_COLUMNS = ["statistic", "p_value", "conf_int_lower", "conf_int_upper"]


def _half_tested(
    df: DataFrame, successes: str, n: str, level: float, yates: bool,
) -> DataFrame:
    """Add the test of a proportion against one half and its score interval."""
    z = normal_quantile((1 + level) / 2)
    size, hits = col(n).cast("double"), col(successes).cast("double")
    p = divide(hits, size)
    off_centre = F.abs(hits - size / 2)
    correction = F.least(F.lit(0.5), off_centre) if yates else F.lit(0.0)
    shifted = df.withColumns({
        "statistic": divide(F.pow(off_centre - correction, 2), size / 4), "__size": size,
        "__low_p": p - divide(correction, size), "__high_p": p + divide(correction, size),
    })
    lower, _ = wilson("__size", "__low_p", z)
    _, upper = wilson("__size", "__high_p", z)
    return shifted.withColumns({
        "p_value": chi_squared_p_value(F.col("statistic")),
        "conf_int_lower": F.when(F.col("__low_p") <= 0, 0.0).otherwise(lower),
        "conf_int_upper": F.when(F.col("__high_p") >= 1, 1.0).otherwise(upper),
    }).drop("__size", "__low_p", "__high_p")


def newcombe_differences(
    df: DataFrame, outcome: str, group: str, x, y, *,
    by: ColumnNames | None = None, weight: str | None = None, z: float = Z_95,
) -> DataFrame:
    """Difference of two (weighted) proportions with Newcombe's interval, per ``by``."""
    by = names(by)
    counted = _two_groups(df, outcome, group, x, y, weight, by)
    for side in ("x", "y"):
        lower, upper = wilson(f"weight_{side}", f"p_{side}", z)
        counted = counted.withColumns({f"lower_{side}": lower, f"upper_{side}": upper})
    lower, upper = newcombe("p_x", "lower_x", "upper_x", "p_y", "lower_y", "upper_y")
    return counted.select(
        *cols(by), "n_x", "n_y", "p_x", "p_y", (F.col("p_x") - F.col("p_y")).alias("p_diff"),
        lower.alias("conf_int_lower"), upper.alias("conf_int_upper"),
    )


# --- from counts -------------------------------------------------------------

def _checked_counts(df: DataFrame, added: list[str], *columns: str) -> None:
    require_number(df, *columns)
    taken = [c for c in added if c in df.columns]
    if taken:
        raise ValueError(f"the table already has column(s) {taken}")


def _score_interval(df: DataFrame, n: str, p: str, z: float, lower: str, upper: str) -> DataFrame:
    sized = df.withColumns({"__n": col(n).cast("double"), "__p": col(p).cast("double")})
    low, high = wilson("__n", "__p", z)
    # Without rows there is no interval.
    return sized.withColumns({
        lower: F.when(F.col("__n") > 0, low), upper: F.when(F.col("__n") > 0, high),
    }).drop("__n", "__p")


def wilson_from_counts(df: DataFrame, n: str, p: str, *, z: float = Z_95) -> DataFrame:
    """Wilson score interval on every row of a table of counts ``n`` and proportions ``p``."""
    _checked_counts(df, ["conf_int_lower", "conf_int_upper"], n, p)
    return _score_interval(df, n, p, z, "conf_int_lower", "conf_int_upper")


def newcombe_from_counts(
    df: DataFrame, n_x: str, p_x: str, n_y: str, p_y: str, *, z: float = Z_95,
) -> DataFrame:
    """Difference ``p_x - p_y`` with Newcombe's interval on every row of a table of counts and
    proportions."""
    _checked_counts(df, ["p_diff", "conf_int_lower", "conf_int_upper"], n_x, p_x, n_y, p_y)
    sided = df
    for side, n, p in (("x", n_x, p_x), ("y", n_y, p_y)):
        sided = _score_interval(sided, n, p, z, f"__lower_{side}", f"__upper_{side}")
        sided = sided.withColumn(f"__p_{side}", col(p).cast("double"))
    lower, upper = newcombe(
        "__p_x", "__lower_x", "__upper_x", "__p_y", "__lower_y", "__upper_y")
    return sided.withColumns({
        "p_diff": F.col("__p_x") - F.col("__p_y"), "conf_int_lower": lower,
        "conf_int_upper": upper,
    }).drop(*[f"__{c}_{s}" for c in ("p", "lower", "upper") for s in ("x", "y")])


def prop_test_from_counts(
    df: DataFrame, successes: ColumnNames, n: ColumnNames, *,
    yates: bool = True, level: float = 0.95,
) -> DataFrame:
    """Chi-squared test of proportions on every row of a table of successes and counts.

    One column of each tests the proportion against one half, two test that the
    proportions are equal.
    """
    successes, n = names(successes), names(n)
    if len(successes) != len(n) or len(n) not in (1, 2):
        raise ValueError("name one or two columns of successes, and as many of counts")
    if len(n) == 1:
        _checked_counts(df, ["proportion", *_HALF_COLUMNS], *successes, *n)
        found = df.withColumn("proportion", divide(
            col(successes[0]).cast("double"), col(n[0]).cast("double")))
        return _half_tested(found, successes[0], n[0], level, yates)
    _checked_counts(df, ["p_x", "p_y", *_EQUALITY_COLUMNS], *successes, *n)
    found = df.withColumns({
        f"p_{side}": divide(col(hits).cast("double"), col(size).cast("double"))
        for side, hits, size in zip(("x", "y"), successes, n)})
    return _equality_tested(found, *n, "p_x", "p_y", yates, level)


def margin_of_error_from_counts(
    df: DataFrame, n: str, p: str, *, level: float = 0.95, z: float | None = None,
) -> DataFrame:
    """Wald standard error, margin and interval on every row of a table of counts and
    proportions."""
    added = ["std_error", "margin_of_error", "conf_int_lower", "conf_int_upper"]
    _checked_counts(df, added, n, p)
    size, share = col(n).cast("double"), col(p).cast("double")
    margin = F.col("margin_of_error")
    return df.withColumns({
        "std_error": F.sqrt(divide(share * (1 - share), size)),
        "margin_of_error": wald_margin(quoted(n), quoted(p), level, z),
    }).withColumns({"conf_int_lower": share - margin, "conf_int_upper": share + margin})


# --- the methods side by side ------------------------------------------------

def compare_proportion_tests(
    df: DataFrame, outcome: str, group: str, x, y, weight: str, *, level: float = 0.95,
) -> DataFrame:
    """Tests of means on a 0/1 outcome beside the tests of proportions, one row per ``method``.

    All report the proportion of x minus that of y.  ``statistic`` is t, or
    chi-squared with one degree of freedom for the ``prop_test`` rows.  All share
    the two passes of the weighted moments.
    """
    require(df, group)
    require_number(df, outcome, weight)
    value = number(outcome)
    wrong = F.raise_error(F.lit(f"{outcome} must hold only 0, 1 or NULL")).cast("double")
    rows = df.select(
        col(group).alias("__group"), weight_or_one(weight).alias("__weight"),
        F.when(is_not_binary(value), wrong).otherwise(value).alias("__value"))
    moments = two_sample_moments(rows, ["__value"], "__group", x, y, "__weight")
    z = normal_quantile((1 + level) / 2)

    def side(name: str) -> Column:
        return F.col(name).cast("double")

    n_x, n_y = side("x_n"), side("y_n")
    sizes = {"plain": (n_x, n_y, side("x_mean"), side("y_mean")),
             "weighted": (side("x_wsum"), side("y_wsum"), side("x_wmean"), side("y_wmean"))}

    def chi(method: str, kind: str, yates: bool) -> Column:
        statistic, reach = _equality_parts(*sizes[kind], yates, z)
        return _method_row(method, sizes[kind][2] - sizes[kind][3], None, F.lit(1.0),
                           statistic, reach)

    def pooled(method: str, kind: str) -> Column:
        w_x, w_y, p_x, p_y = sizes[kind]
        p = divide(p_x * w_x + p_y * w_y, w_x + w_y)
        spread = p * (1 - p) * (divide(F.lit(1.0), n_x) + divide(F.lit(1.0), n_y))
        return _method_row(method, p_x - p_y, F.sqrt(spread), n_x + n_y - 2, None, None)

    means = differences_by_method(moments).select(
        F.col("method"), F.col("diff_in_means").alias("p_diff"), "std_error", "df",
        *[F.lit(None).cast("double").alias(c) for c in ("chi", "reach")])
    shares = moments.select(F.inline(F.array(
        pooled("two_proportion", "plain"), pooled("two_proportion_weighted", "weighted"),
        chi("prop_test", "plain", False), chi("prop_test_yates", "plain", True),
        chi("prop_test_weighted", "weighted", False),
    )))
    t = divide(F.col("p_diff"), F.col("std_error"))
    of_t = t_quantile((1 + level) / 2, F.col("df")) * F.col("std_error")
    is_chi = F.col("chi").isNotNull()
    low, high = (F.col("p_diff") - F.col("reach"), F.col("p_diff") + F.col("reach"))
    return (
        means.unionByName(shares)
        .withColumn("statistic", F.coalesce("chi", t))
        .withColumns({
            "p_value": F.when(is_chi, chi_squared_p_value(F.col("statistic"))).otherwise(
                t_p_value(F.col("statistic"), F.col("df"))),
            "reach": F.coalesce(F.col("reach"), of_t),
        })
        .select(
            "method", "p_diff", "std_error", "df", "statistic", "p_value",
            F.when(is_chi, F.greatest(low, F.lit(-1.0))).otherwise(low).alias("conf_int_lower"),
            F.when(is_chi, F.least(high, F.lit(1.0))).otherwise(high).alias("conf_int_upper"))
    )


def _method_row(method: str, difference, std_error, df, chi, reach) -> Column:
    nothing = F.lit(None).cast("double")
    return F.struct(
        F.lit(method).alias("method"), difference.alias("p_diff"),
        (nothing if std_error is None else std_error).alias("std_error"), df.alias("df"),
        (nothing if chi is None else chi).alias("chi"),
        (nothing if reach is None else reach).alias("reach"))
