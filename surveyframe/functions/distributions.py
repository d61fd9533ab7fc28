"""Tail areas and quantiles used by the tests, as column expressions.

The t and chi-squared tails call the incomplete beta and the error function of
Apache Commons Math, which ships with Spark, through the public ``reflect``
function.  ``reflect`` may not stand inside an aggregate function, so these are
applied to the aggregated rows.  A missing argument gives NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, functions as F

# From so many degrees of freedom the expansion around the normal quantile is exact to
# the last digits.
_MANY = 1.0e4
_STEPS = 3


def normal_quantile(p: float) -> float:
    """Standard normal quantile for a level fixed when the plan is written."""
    return NormalDist().inv_cdf(p)


def _erf(name: str, x: Column) -> Column:
    return F.reflect(
        F.lit("org.apache.commons.math3.special.Erf"), F.lit(name), x).cast("double")


def inverse_error_function(x: Column) -> Column:
    """The number whose error function is ``x``; NULL unless -1 < x < 1."""
    return F.when((x > -1) & (x < 1), _erf("erfInv", x.cast("double")))


def _upper_normal(q: Column) -> Column:
    """Normal quantile with ``q`` above it, 0 < q <= 0.5; one step of Halley's method sharpens it in
    the tail, where 1 - 2 q has lost digits."""
    def sharper(z: Column) -> Column:
        gap = (_erf("erfc", z / math.sqrt(2)) / 2 - q) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)
        return z + gap / (1 - z * gap / 2)

    return _let(math.sqrt(2) * _erf("erfInv", 1 - 2 * q), sharper)


def normal_quantile_by_row(p: Column) -> Column:
    """Standard normal quantile of a level that differs by row; NULL unless 0 < p < 1."""
    p = p.cast("double")
    return F.when((p > 0) & (p < 0.5), -_upper_normal(p)).when(
        (p >= 0.5) & (p < 1), _upper_normal(1 - p))


def _beta(x: Column, a: Column, b: Column) -> Column:
    return F.reflect(
        F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta"), x, a, b
    ).cast("double")


def _t_both_tails(t: Column, df: Column) -> Column:
    return _beta(df / (df + t * t), df / F.lit(2.0), F.lit(0.5))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; the degrees of freedom may be fractional."""
    known = t.isNotNull() & df.isNotNull() & (df > 0)
    return F.when(known, _t_both_tails(t, df))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _t_near(inside: float | Column, df: Column, beta: Column) -> Column:
    """The t with ``inside``, at most one half, between -t and t: from the density at the centre, then
    Halley's method on what lies inside, which keeps its digits where the tails are nearly all."""
    linear = inside / 2 * F.sqrt(df) * beta

    def step(t: Column, _number: Column) -> Column:
        density = 2 * F.exp(-(df + 1) / 2 * F.log1p(t * t / df)) / (F.sqrt(df) * beta)
        off = (_beta(t * t / (df + t * t), F.lit(0.5), df / F.lit(2.0)) - inside) / density
        return _let(off, lambda u: t - u / (1 + u * (df + 1) * t / (2 * (df + t * t))))

    start = linear * (1 + (df + 1) / (6 * df) * linear * linear)
    return F.aggregate(_numbers(), start, step)


def _numbers() -> Column:
    return F.array(*[F.lit(i) for i in range(_STEPS)])


def _t_start(tails: float | Column, df: Column, beta: Column, z: float | Column) -> Column:
    """A first t for both tails: far out from the leading terms of the tail, else from the normal
    quantile ``z``."""
    tails = tails if isinstance(tails, Column) else F.lit(tails)
    half = df / 2

    def chosen(leading: Column) -> Column:
        far = leading * F.exp(-F.log1p(leading * half / (2 * (half + 1))) / half)
        return F.when(leading < 0.3, F.sqrt(df * (1 / far - 1))).otherwise(
            _t_of_many(z, df))

    return _let(F.exp(F.log(tails * half * beta) / half), chosen)


def _t_of_many(z: float | Column, df: Column) -> Column:
    """Expansion of the quantile in powers of 1 / df around the normal quantile."""
    terms = (
        (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    total = z if isinstance(z, Column) else F.lit(z)
    for power, term in enumerate(terms, 1):
        numerator = term if isinstance(term, Column) else F.lit(term)
        total = total + numerator / F.pow(df, F.lit(power))
    return total


def t_quantile(p: float, df: Column) -> Column:
    """Quantile of Student's t for an upper level ``p`` > 0.5.

    A closed form starts it; three steps of Halley's method on the logarithms of
    the tail and of t finish it, so that heavy tails need no more steps than
    light ones and there is no largest value.  Near the centre the steps are taken on what
    lies inside.
    """
    if not 0.5 < p < 1:
        raise ValueError("p must lie between 0.5 and 1")
    tails = 2 * (1 - p)
    return _t_quantile(tails, math.log(tails), normal_quantile(p), df)


def t_quantile_by_row(p: Column, df: Column) -> Column:
    """Quantile of Student's t for an upper level that differs by row; NULL unless 0.5 < p < 1."""
    p = p.cast("double")

    def at(z: Column) -> Column:
        tails = 2 * (1 - p)
        return _t_quantile(tails, F.log(tails), z, df)

    return F.when((p > 0.5) & (p < 1), _let(normal_quantile_by_row(p), at))


def _t_quantile(
    tails: float | Column, log_tails: float | Column, z: float | Column, df: Column,
) -> Column:
    log_beta = F.reflect(
        F.lit("org.apache.commons.math3.special.Beta"), F.lit("logBeta"),
        df / F.lit(2.0), F.lit(0.5)).cast("double")

    def stepped(beta: Column) -> Column:
        def step(t: Column, _number: Column) -> Column:
            def moved(tail: Column) -> Column:
                # Slope of log tail by log t, and the slope of its logarithm.
                slope = 2 * t * F.exp(-(df + 1) / 2 * F.log1p(t * t / df)) / (
                    F.sqrt(df) * beta * tail)
                bend = 1 - (df + 1) / (df / (t * t) + 1) + slope
                gap = F.log(tail) - log_tails
                return t * F.exp(2 * gap / (2 * slope + gap * bend))

            return _let(_t_both_tails(t, df), moved)

        return F.aggregate(_numbers(), _t_start(tails, df, beta, z), step)

    def chosen(beta: Column) -> Column:
        if isinstance(tails, Column):
            return F.when(tails > 0.5, _t_near(1 - tails, df, beta)).otherwise(stepped(beta))
        return _t_near(1 - tails, df, beta) if tails > 0.5 else stepped(beta)

    few = _let(F.exp(log_beta), chosen)
    return F.when(df >= _MANY, _t_of_many(z, df)).when(df > 0, few)


def chi_squared_p_value(statistic: Column) -> Column:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    tail = F.reflect(
        F.lit("org.apache.commons.math3.special.Erf"), F.lit("erfc"),
        F.sqrt(statistic / 2),
    ).cast("double")
    return F.when(statistic.isNotNull(), tail)
