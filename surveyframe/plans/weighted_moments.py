"""Weighted moments in one scan, without the cancellation of plain power sums.

Spark's covariances are kept per task as means and centred products and combined
pairwise, so they are accurate for any mean.  Weighted moments follow from
covariances between values, weights and weighted values: over n rows with plain means,
``sum w (y - mean y) = n cov(w, y)`` and
``sum w (x - mean x)(y - mean y) = n (cov(w x, y) - mean x * cov(w, y))``.

Each value is the sum of two parts, its leading 24 bits and the exact rest.  Where
the mean is large beside the spread, the leading parts are nearly alike and the rest
holds the spread: sums over the parts keep the digits that sums over the values lose.

All arguments are SQL text.  ``name`` is a double column; its parts, from :func:`split`, stand
beside it, and the names of its aggregates begin with it and ``tag``.  All rows need a value
and a weight, or neither counts.
"""

from __future__ import annotations

PARTS = ("hi", "lo")


def split(name: str) -> list[str]:
    """The two parts of a column."""
    high = f"CASE WHEN abs({name}) < 1e38D THEN CAST(CAST({name} AS FLOAT) AS DOUBLE) ELSE 0D END"
    high = f"CASE WHEN {name} IS NOT NULL THEN {high} END"
    return [f"{high} AS {name}_hi", f"{name} - {high} AS {name}_lo"]


def _products(x: str, y: str) -> list[tuple[str, str, int]]:
    """The pairs of parts that make up a product, and how often each counts."""
    if x == y:
        return [(f"{x}_hi", f"{x}_hi", 1), (f"{x}_lo", f"{x}_hi", 2), (f"{x}_lo", f"{x}_lo", 1)]
    return [(f"{x}_{a}", f"{y}_{b}", 1) for a in PARTS for b in PARTS]


def _plain_sums(w: str, name: str, rows: str, tag: str) -> list[str]:
    used = f"{rows} AND ({w}) IS NOT NULL AND {name} IS NOT NULL"
    return [
        f"count(*) FILTER (WHERE {used}) AS {tag}{name}_n",
        f"sum({w}) FILTER (WHERE {used}) AS {tag}{name}_w",
        *[f"avg({name}_{p}) FILTER (WHERE {used}) AS {tag}{name}_{p}" for p in PARTS],
        *[f"covar_pop({w}, {name}_{p}) FILTER (WHERE {used}) AS {tag}{name}_{p}_c" for p in PARTS],
    ]


def sums(
    w: str, names: list[str], products: list[tuple[str, str]], rows: str = "true", tag: str = "",
) -> list[str]:
    """The aggregates, over the rows where ``rows`` holds, that the functions below put together."""
    found = [text for name in names for text in _plain_sums(w, name, rows, tag)]
    for x, y in products:
        used = f"{rows} AND ({w}) IS NOT NULL"
        found += [
            f"covar_pop(({w}) * {p}, {q}) FILTER (WHERE {used}) AS {tag}{p}_{q}"
            for p, q, _ in _products(x, y)]
    return found


def _shift(name: str) -> str:
    """How far the weighted mean lies from the plain one."""
    return f"try_divide({name}_n * ({name}_hi_c + {name}_lo_c), {name}_w)"


def mean(name: str, tag: str = "") -> str:
    """The weighted mean."""
    name = tag + name
    return f"({name}_hi + ({name}_lo + {_shift(name)}))"


def _around_plain(x: str, y: str, tag: str) -> str:
    """Weighted sum of the products of the deviations from the plain means."""
    return " + ".join(
        f"{times} * {tag}{y}_n * ({tag}{p}_{q} - {tag}{p} * {tag}{q}_c)"
        for p, q, times in _products(x, y))


def spread(x: str, y: str, tag: str = "") -> str:
    """Weighted sum of the products of the deviations of x and y from their weighted means."""
    moved = (f"{_around_plain(x, y, tag)}"
             f" - {tag}{y}_w * {_shift(tag + x)} * {_shift(tag + y)}")
    return f"greatest({moved}, 0D)" if x == y else f"({moved})"


def score(name: str, tag: str, square_tag: str) -> str:
    """Sum of the squares of the weighted deviations from the weighted mean.

    ``square_tag`` names the sums over the same rows with the squares of the weights.
    """
    d, squared = _shift(tag + name), square_tag + name
    return (f"greatest({_around_plain(name, name, square_tag)}"
            f" - 2 * {d} * {squared}_n * ({squared}_hi_c + {squared}_lo_c)"
            f" + {d} * {d} * {squared}_w, 0D)")
