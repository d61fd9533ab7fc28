"""Putting statistics of the table, or of its groups, back on its rows.

* One set of statistics for the whole table goes on as a scalar subquery: one
  row by construction, no join.
* Statistics per group are computed once into the shared folder.  Their size
  is then known: few groups are broadcast, so the rows stay where they are;
  many groups are joined through a shuffle, where adaptive execution splits the
  partitions of hot groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.columns import col, cols
from .store import stored

# Size up to which group statistics are broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def only_row(stats: DataFrame) -> Column:
    """The single row of ``stats`` as a struct column usable on any other frame."""
    return stats.select(F.struct(*cols(stats.columns)).alias("row")).scalar()


def with_only_row(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``rows`` with the columns of the one-row frame ``stats`` on each of them."""
    placed = rows.withColumn("__row", only_row(stats))
    return placed.select(*cols(rows.columns), "__row.*")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed now and stored in the session's shared folder.

    Later steps read the stored result, whatever executors are lost meanwhile.
    """
    return stored(df, "statistics")


def stored_bytes(stats: DataFrame) -> int:
    """Rough size of a small table: eight bytes a number, and the length of everything else."""
    size = F.lit(0)
    for field in stats.schema.fields:
        held = col(field.name)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(held), F.lit(0))
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            size = size + 16 + 2 * F.octet_length(F.to_json(F.struct(held)))
        else:
            size = size + 16
    return stats.agg(F.sum(size)).first()[0] or 0


def join_groups(
    rows: DataFrame, stats: DataFrame, by: Sequence[str], *,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``rows`` with the statistics of their group; ``stats`` comes from :func:`kept`.

    A NULL key is a group like any other.  Rows without a group keep NULLs.
    """
    renamed = stats.withColumnsRenamed({c: f"__group_{c}" for c in by})
    small = stored_bytes(stats) <= broadcast_bytes
    renamed = F.broadcast(renamed) if small else renamed.hint("shuffle_merge")
    same = [col(c).eqNullSafe(col(f"__group_{c}")) for c in by]
    return rows.join(renamed, same, "left").drop(*[f"__group_{c}" for c in by])


def with_stats(rows: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach ``stats`` to ``rows``: as one row without ``by``, else group by group."""
    return join_groups(rows, stats, by) if by else with_only_row(rows, stats)
