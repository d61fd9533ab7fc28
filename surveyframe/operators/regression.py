"""Straight-line regression on one regressor, mostly a 0/1 dummy, and linear models with factors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    ColumnNames, col, divide, names, number, require, require_number, weight_or_one,
)
from ..functions.distributions import t_p_value, t_quantile
from ..plans import weighted_moments as weighted
from ..plans.attach import with_only_row
from ..plans.normal_equations import cholesky, gram, inverse

INTERCEPT = "(Intercept)"
# The system of a linear model is solved in one row; more coefficients than this are refused.
MAX_COEFFICIENTS = 300


def _pairs(df: DataFrame, y: str, x: str, weight: str | None) -> DataFrame:
    """Complete rows; weights of zero take no part, one below zero is an error."""
    require_number(df, y, x, weight)
    rows = df.select(
        number(y).alias("y"), number(x).alias("x"),
        *([weight_or_one(weight).alias("w")] if weight else []),
    )
    complete = F.col("y").isNotNull() & F.col("x").isNotNull()
    return rows.filter(complete & (F.col("w") > 0) if weight else complete)


def _sums(df: DataFrame, y: str, x: str, weight: str | None) -> DataFrame:
    """One row: n, total, mean_x, mean_y and the centred sums sxx, sxy, syy."""
    rows = _pairs(df, y, x, weight)
    if weight is None:
        return rows.agg(
            F.count("*").alias("n"), F.count("*").cast("double").alias("total"),
            F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
            F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"),
            F.regr_syy("y", "x").alias("syy"),
        )
    pairs = {"sxx": ("x", "x"), "sxy": ("x", "y"), "syy": ("y", "y")}
    sums = rows.selectExpr("*", *weighted.split("x"), *weighted.split("y")).agg(
        *[F.expr(text) for text in weighted.sums("w", ["x", "y"], list(pairs.values()))])
    return sums.selectExpr(
        "x_n AS n", "x_w AS total", f"{weighted.mean('x')} AS mean_x",
        f"{weighted.mean('y')} AS mean_y",
        *[f"{weighted.spread(a, b)} AS {name}" for name, (a, b) in pairs.items()])


def _line(sums: DataFrame) -> DataFrame:
    """Add slope and intercept."""
    return (
        sums.withColumn("slope", divide(F.col("sxy"), F.col("sxx")))
        .withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))
    )


def linear_regression(
    df: DataFrame, y: str, x: str, *, weight: str | None = None, level: float = 0.95,
) -> DataFrame:
    """Least squares of ``y`` on ``x``: a row for the intercept and one for the slope.

    The interval of each coefficient is centred on that coefficient.
    """
    fitted = _line(_sums(df, y, x, weight)).withColumn(
        "df", F.col("n").cast("double") - 2
    ).withColumn("residual_variance", divide(
        F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)), F.col("df")))
    of_slope = divide(F.col("residual_variance"), F.col("sxx"))
    of_intercept = F.col("residual_variance") * (
        divide(F.lit(1.0), F.col("total"))
        + divide(F.col("mean_x") * F.col("mean_x"), F.col("sxx")))

    def term(name: str, estimate: str, variance: Column) -> Column:
        return F.struct(
            F.lit(name).alias("term"), col(estimate).alias("estimate"),
            F.sqrt(variance).alias("std_error"), F.col("df").alias("df"))

    return (
        fitted.select(F.inline(F.array(
            term(INTERCEPT, "intercept", of_intercept), term(x, "slope", of_slope))))
        .withColumn("statistic", divide(F.col("estimate"), F.col("std_error")))
        .withColumn("p_value", t_p_value(F.col("statistic"), F.col("df")))
        .withColumn("reach", t_quantile((1 + level) / 2, F.col("df")) * F.col("std_error"))
        .withColumn("conf_int_lower", F.col("estimate") - F.col("reach"))
        .withColumn("conf_int_upper", F.col("estimate") + F.col("reach"))
        .drop("reach")
    )


def factor_levels(df: DataFrame, factor: str) -> list[str]:
    """The levels of a factor as text, in ascending order; a missing one is none of them."""
    found = df.select(col(factor).cast("string").alias("level")).filter(
        "level IS NOT NULL").distinct().orderBy("level").limit(MAX_COEFFICIENTS + 1).collect()
    if len(found) > MAX_COEFFICIENTS:
        raise ValueError(f"{factor} has more than {MAX_COEFFICIENTS} levels")
    return [r.level for r in found]


def linear_model(
    df: DataFrame, y: str, regressors: ColumnNames | None = None, *,
    factors: ColumnNames | Mapping[str, Sequence[str]] | None = None, weight: str | None = None,
    level: float = 0.95,
) -> DataFrame:
    """Least squares of ``y`` on numbers and factors: a row for the intercept and each coefficient.

    A factor gives a coefficient for each level but its first one, under the name of the factor and
    the level.  Levels are looked up, in ascending order, or given as a mapping of each factor to
    its levels, base first; rows with other levels are then left out, as are incomplete rows.
    A coefficient whose column is a combination of those before it is ``aliased`` and has no
    estimate.  Values are centred first, so large means cost no digits.
    """
    regressors = names(regressors)
    given = factors if isinstance(factors, Mapping) else None
    chosen = list(given) if given is not None else names(factors)
    require(df, *chosen)
    require_number(df, y, weight, *regressors)
    levels = {f: list(given[f]) if given is not None else factor_levels(df, f) for f in chosen}
    terms = [INTERCEPT, *regressors, *[f"{f}{v}" for f in chosen for v in levels[f][1:]]]
    size = len(terms)
    if size > MAX_COEFFICIENTS:
        raise ValueError(f"{size} coefficients; at most {MAX_COEFFICIENTS} are solved")

    xs, gs = [f"x{i}" for i in range(len(regressors))], [f"g{i}" for i in range(len(chosen))]
    rows = df.select(
        number(y).alias("y"), weight_or_one(weight).alias("w"),
        *[number(r).alias(x) for r, x in zip(regressors, xs)],
        *[col(f).cast("string").alias(g) for f, g in zip(chosen, gs)])
    complete = F.col("y").isNotNull() & (F.col("w") > 0)
    for x in xs:
        complete = complete & F.col(x).isNotNull()
    for g, f in zip(gs, chosen):
        complete = complete & F.col(g).isin(levels[f])
    rows = rows.filter(complete)
    centre = rows.agg(*[F.avg(c).alias(f"mean_{c}") for c in ("y", *xs)])

    def entry(place: Column, value: Column) -> Column:
        return F.struct(place.cast("int").alias("place"), value.alias("value"))

    entries, at = [entry(F.lit(0), F.lit(1.0))], 1
    for x in xs:
        entries.append(entry(F.lit(at), F.col(x) - F.col(f"mean_{x}")))
        at += 1
    for g, f in zip(gs, chosen):
        numbers = F.create_map(*[F.lit(v) for i, name in enumerate(levels[f]) for v in (name, i)])
        place = F.element_at(numbers, F.col(g))
        entries.append(F.when(place > 0, entry(place + (at - 1), F.lit(1.0))))
        at += len(levels[f]) - 1 if levels[f] else 0
    entries.append(entry(F.lit(size), F.col("y") - F.col("mean_y")))
    listed = with_only_row(rows, centre).select(
        "w", F.filter(F.array(*entries), lambda e: e.isNotNull()).alias("entries"))

    # The last row of the factorisation belongs to y: what it projects on each column, and what
    # is left.
    solved = gram(listed, size + 1).withColumn("lower", cholesky(F.col("gram"), size + 1))
    solved = solved.withColumn("of_y", F.element_at("lower", -1)).withColumn(
        "lower", F.slice("lower", 1, size))
    solved = solved.withColumn("inverse", inverse(F.col("lower"), size)).withColumns({
        "used": F.transform("lower", lambda r: F.element_at(r, -1) > 0),
        "projected": F.slice("of_y", 1, size),
        "left": F.pow(F.element_at("of_y", -1), 2)})
    solved = with_only_row(solved, centre)
    rank = F.size(F.filter("used", lambda u: u))
    # The intercept is that of the values before they were centred.
    shift = F.array(F.lit(1.0), *[-F.col(f"mean_{x}") for x in xs],
                    *[F.lit(0.0)] * (size - 1 - len(xs)))
    solved = solved.withColumns({"df": (F.col("n") - rank).cast("double"), "shift": shift})
    solved = solved.withColumn("residual_variance", divide(F.col("left"), F.col("df")))

    def weights(i: Column) -> Column:
        """What the i-th coefficient takes of each projection."""
        def of_row(r: Column) -> Column:
            shifted = F.aggregate(
                F.zip_with(r, F.col("shift"), lambda a, b: a * b), F.lit(0.0), lambda t, p: t + p)
            return F.when(i == 0, shifted).otherwise(F.get(r, i))
        return F.transform("inverse", of_row)

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda t, p: t + p)

    def term(i: Column) -> Column:
        found = weights(i)
        estimate = total(F.zip_with(found, F.col("projected"), lambda a, b: a * b))
        variance = total(F.transform(found, lambda a: a * a)) * F.col("residual_variance")
        used = F.get(F.col("used"), i)
        return F.struct(
            F.get(F.array(*[F.lit(t) for t in terms]), i).alias("term"),
            F.when(used, F.when(i == 0, estimate + F.col("mean_y")).otherwise(estimate))
            .alias("estimate"),
            F.when(used, F.sqrt(variance)).alias("std_error"), F.col("df").alias("df"),
            (~used & (F.col("n") > 0)).alias("aliased"))

    numbers = F.sequence(F.lit(0), F.lit(size - 1))
    return (
        solved.select(F.inline(F.transform(numbers, term)))
        .withColumn("statistic", divide(F.col("estimate"), F.col("std_error")))
        .withColumn("p_value", t_p_value(F.col("statistic"), F.col("df")))
        .withColumn("reach", t_quantile((1 + level) / 2, F.col("df")) * F.col("std_error"))
        .withColumn("conf_int_lower", F.col("estimate") - F.col("reach"))
        .withColumn("conf_int_upper", F.col("estimate") + F.col("reach"))
        .select("term", "estimate", "std_error", "df", "statistic", "p_value", "conf_int_lower",
                "conf_int_upper", "aliased")
    )


def predictions(
    df: DataFrame, y: str, x: str, *, weight: str | None = None,
    predicted: str = "predicted", residual: str = "residual",
) -> DataFrame:
    """Every row with the fitted value and the residual."""
    taken = [c for c in (predicted, residual) if c in df.columns]
    if taken:
        raise ValueError(f"the table already has column(s) {taken}")
    line = _line(_sums(df, y, x, weight)).select(
        F.col("slope").alias("__slope"), F.col("intercept").alias("__intercept"))
    fitted = F.col("__intercept") + F.col("__slope") * number(x)
    return (
        with_only_row(df, line).withColumn(predicted, fitted)
        .withColumn(residual, number(y) - col(predicted))
        .drop("__slope", "__intercept")
    )


def slope_standard_error(df: DataFrame, y: str, x: str) -> DataFrame:
    """Standard error of the slope from the residuals of every row."""
    rows = df.select(number(y).alias("y"), number(x).alias("x")).filter(
        F.col("y").isNotNull() & F.col("x").isNotNull())
    line = _line(_sums(df, y, x, None)).select("slope", "intercept")
    residual = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    return with_only_row(rows, line).agg(
        F.count("*").alias("n"),
        divide(
            F.sqrt(divide(F.sum(residual * residual), F.count("*").cast("double") - 2)),
            F.sqrt(F.regr_sxx("y", "x")),
        ).alias("std_error"),
    )
