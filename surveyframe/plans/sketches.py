"""Quantile sketches that are kept, and exact quantiles in one scan with their help.

A KLL sketch of each part of a table (a day, a file) is written once.  Merged, the
sketches bracket every wanted rank, so the scan that used to look for the brackets is
gone: one scan counts what lies inside them value by value, and all else in bulk.  The
outlier fences lie between combinations of the quartiles' brackets, so the same scan counts
the values at and beyond them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col
from .attach import kept
from .quantiles import (
    ROWS_PER_SALT, SALTS, SMALL_GROUP, _cells, _closer_brackets, _narrowed, _picked_from, _stacked,
    _zoned,
)

# Size of a sketch; up to about three times so many values are kept of a part of a group.
SKETCH_SIZE = 16_384
# A rank in a sketch errs by no more than this share of the rows in 99 of 100 cases.
_ERROR = 2.296 / SKETCH_SIZE ** 0.9723
# Brackets reach four times as far (ten standard deviations) and two ranks of a group of FEW_ROWS;
# of a smaller group all values lie inside.
FEW_ROWS = 10_000
_MARGIN = 4 * _ERROR + 2 / FEW_ROWS
_SLACK = 1e-12
QUARTILES = (0.25, 0.5, 0.75)


def write_sketches(
    df: DataFrame, path: str, variables: Sequence[str], by: Sequence[str], part: str,
) -> None:
    """Sketch every variable by group and part; the parts in ``df`` replace those in ``path``."""
    keys = [f"__by{i}" for i in range(len(by))]
    rows, _ = _narrowed(df.withColumn("__of_part", col(part).cast("string")), variables,
                        [*by, "__of_part"])
    rows = rows.withColumnRenamed(f"__by{len(by)}", "part")
    sketched = _stacked(rows, len(variables), ["part", *keys]).groupBy("part", *keys, "variable").agg(
        F.count("value").alias("n"), F.kll_sketch_agg_double("value", SKETCH_SIZE).alias("sketch"))
    names = F.array(*[F.lit(v) for v in variables])
    sketched = sketched.withColumn("variable", F.get(names, F.col("variable")))
    sketched.repartition("part").write.partitionBy("part").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def _read_brackets(
    spark: SparkSession, path: str, variables: Sequence[str], keys: Sequence[str],
) -> DataFrame:
    """(keys, variable, n, low, high): between which values each quartile lies."""
    numbers = F.create_map(*[F.lit(x) for i, v in enumerate(variables) for x in (v, i)])
    stored = spark.read.parquet(path).filter(
        F.col("variable").isin(list(variables)) & (F.col("n") > 0))
    merged = stored.withColumn("variable", F.element_at(numbers, F.col("variable"))).groupBy(
        *keys, "variable").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"))

    def at(ranks: list[float], few: float) -> Column:
        def read(ranks: list[float]) -> Column:
            return F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(r) for r in ranks]))

        return F.when(F.col("n") >= FEW_ROWS, read(ranks)).otherwise(read([few] * len(ranks)))

    return merged.select(
        *keys, "variable", "n",
        at([p - _MARGIN for p in QUARTILES], 0.0).alias("low"),
        at([p + _MARGIN for p in QUARTILES], 1.0).alias("high"))


def _with_fence_brackets(brackets: DataFrame, keys: Sequence[str], fence: float) -> DataFrame:
    """Two more brackets, for the fences that lie ``fence`` quartile distances off the quartiles."""
    low, high = F.col("low"), F.col("high")
    slack = _SLACK * (F.abs(low[0]) + F.abs(high[0]) + F.abs(low[2]) + F.abs(high[2]))
    more = (1 + fence)
    return brackets.select(
        *keys,
        F.concat(low, F.array(more * low[0] - fence * high[2] - slack,
                              more * low[2] - fence * high[0] - slack)).alias("low"),
        F.concat(high, F.array(more * high[0] - fence * low[2] + slack,
                               more * high[2] - fence * low[0] + slack)).alias("high"))


def summary_cells(
    df: DataFrame, path: str, variables: Sequence[str], by: Sequence[str], fence: float,
    small_group: int = SMALL_GROUP,
) -> tuple[DataFrame, list[str]]:
    """Counts from one scan of ``df`` that determine its quartiles and what lies beyond the fences.

    Groups of so many rows that a sketch's bracket holds more than ``small_group`` of them are
    closed in further first, which takes a scan for each factor of about 400.
    """
    narrow, keys = _narrowed(df, variables, by)
    keys = [*keys, "variable"]
    rows = _stacked(narrow, len(variables), keys[:-1])
    brackets = kept(_read_brackets(df.sparkSession, path, variables, keys[:-1]))
    inside = int((brackets.agg(F.max("n")).first()[0] or 0) * 2 * len(QUARTILES) * _MARGIN)
    while inside > small_group:
        salts = max(1, min(SALTS, inside // ROWS_PER_SALT))
        brackets = kept(_closer_brackets(rows, keys, QUARTILES, brackets, salts))
        inside //= 400
    placed = kept(_with_fence_brackets(brackets, keys, fence))
    zoned = _zoned(rows, keys, len(QUARTILES) + 2, placed)
    return kept(_cells(zoned, keys)), keys


def quantiles_of_cells(
    cells: DataFrame, keys: Sequence[str], probabilities: Sequence[float],
) -> DataFrame:
    """Exact quantiles by group and variable; a rank outside its bracket stops the job."""
    return _picked_from(cells, keys, probabilities)
