"""Publication rules for estimated proportions.

An estimate is suppressed, or marked unreliable, by the number of successes
``x``, the number of rows ``n`` (both unweighted) and the coefficient of
variation ``cv``.  The limits follow the public-health data suppression
guidelines the survey tables are published under.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the publication rules.
FEW_SUCCESSES = 10
SMALL_SUCCESSES = 20
SMALL_SAMPLE = 100
HIGH_CV = 0.3
EXTREME_CV = 0.5

KINDS = ("sample", "population")


def publication_flags(
    x: str, n: str, cv: str, *,
    strict: bool = True, confidential: bool = True, kind: str = "sample",
) -> tuple[Column, Column]:
    """Return the 0/1 columns (suppressed, unreliable) from three column names.

    An estimate without a coefficient of variation cannot be judged and is
    suppressed.  The two flags are independent of each other.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")

    small = f"({x} < {SMALL_SUCCESSES} OR {n} < {SMALL_SAMPLE})"
    few = f"{x} < {FEW_SUCCESSES}"
    doubtful = f"({cv} > {HIGH_CV}D AND {cv} <= {EXTREME_CV}D)"

    if strict:
        by_count = few if kind == "sample" and not confidential else small
        suppressed, unreliable = f"{by_count} OR {cv} > {HIGH_CV}D", "false"
    elif confidential:
        suppressed, unreliable = f"{small} OR {cv} > {EXTREME_CV}D", f"{small} OR {doubtful}"
    else:
        between = f"({x} >= {FEW_SUCCESSES} AND {x} < {SMALL_SUCCESSES})"
        suppressed, unreliable = f"{few} OR {cv} > {EXTREME_CV}D", f"{doubtful} OR {between}"

    return _flag(f"{suppressed} OR {cv} IS NULL"), _flag(unreliable)


def _flag(condition: str) -> Column:
    return F.expr(f"CASE WHEN {condition} THEN 1 ELSE 0 END")
