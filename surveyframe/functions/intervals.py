"""Interval formulas for proportions, as column expressions.

The operands are SQL text, usually column names, of counts and proportions that
some aggregate has already produced, so none of them costs a pass over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .distributions import normal_quantile

# Fixed values of the survey tables: the usual 95 % multiplier, and the small
# amount that keeps the coefficient of variation finite at p = 0 or p = 1.
Z_95 = 1.96
CV_OFFSET = 0.001


def wilson(n: str, p: str, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval (lower, upper) for proportion ``p`` of ``n``."""
    z2 = z * z
    centre = f"({n} * {p} + {z2 / 2}D) / ({n} + {z2}D)"
    reach = f"{z}D * sqrt({n} * {p} * (1 - {p}) + {z2 / 4}D) / ({n} + {z2}D)"
    return F.expr(f"{centre} - {reach}"), F.expr(f"{centre} + {reach}")


def newcombe(
    p1: str, lower1: str, upper1: str, p2: str, lower2: str, upper2: str, scale: str = "1D",
) -> tuple[Column, Column]:
    """Newcombe's interval (lower, upper) for ``scale * (p1 - p2)`` from two score intervals."""
    down = f"hypot({p1} - {lower1}, {upper2} - {p2})"
    up = f"hypot({upper1} - {p1}, {p2} - {lower2})"
    return (
        F.expr(f"{scale} * ({p1} - {p2} - {down})"),
        F.expr(f"{scale} * ({p1} - {p2} + {up})"),
    )


def wald_margin(n: str, p: str, level: float = 0.95, z: float | None = None) -> Column:
    """Margin of error of a proportion; ``z`` overrides the level's own quantile."""
    multiplier = normal_quantile((1 + level) / 2) if z is None else z
    return F.expr(f"{multiplier}D * sqrt(try_divide({p} * (1 - {p}), {n}))")


def sample_size(p: str, margin: float, z: float = Z_95) -> Column:
    """Rows needed to estimate ``p`` within ``margin``."""
    return F.expr(f"{p} * (1 - {p}) / {(margin / z) ** 2}D")


def standard_error_of_interval(lower: str, upper: str) -> Column:
    """Standard error implied by an interval; always the 1.96 multiplier."""
    return F.expr(f"({upper} - {lower}) / {2 * Z_95}D")


def coefficient_of_variation(standard_error: str, p: str) -> Column:
    """Standard error relative to the rarer outcome's proportion."""
    return F.expr(f"{standard_error} / (least({p}, 1 - {p}) + {CV_OFFSET}D)")
