"""Counts and weights behind every proportion, as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.columns import checked_binary, col, is_not_binary, number, weight_or_one

SUMS = ("n_weighted", "n_unweighted", "x_weighted", "x_unweighted", "bad_rows")


def proportion_sums(
    outcome: str, weight: str | None = None, among: Column | None = None, prefix: str = "",
) -> list[Column]:
    """Aggregates for one 0/1 outcome, over the rows where ``among`` holds.

    The number of rows includes those whose outcome is missing.  A missing
    weight adds nothing to the weighted sums but its row is counted.
    ``bad_rows`` counts outcomes other than 0, 1 and NULL.
    """
    here = F.lit(True) if among is None else among
    y, w = number(outcome), weight_or_one(weight)
    hit = here & (y == 1)
    zero = F.lit(0.0)
    found = {
        "n_weighted": F.coalesce(F.sum(F.when(here, w)), zero),
        "n_unweighted": F.count_if(here),
        "x_weighted": F.coalesce(F.sum(F.when(hit, w)), zero),
        "x_unweighted": F.count_if(hit),
        "bad_rows": F.count_if(here & is_not_binary(y)),
    }
    return [found[name].alias(prefix + name) for name in SUMS]


def checked(outcome: str, prefix: str = "", column: str = "n_weighted") -> Column:
    """The named sum, or an error where the outcome was not 0/1."""
    return checked_binary(outcome, col(prefix + column), col(prefix + "bad_rows"))
