"""Connected components of a link table by alternating stars.

Each round ties every node to the least node around it, on the large side and
then on the small side.  Links are rewritten, never gathered: a node with many
links is a sum and a join, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.store import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every node of ``links`` (a, b): the least id that it can reach."""
    a, b = F.col("a"), F.col("b")
    edges = stored(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
        "links")
    while not _all_stars(edges):
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("least"))
        large = (both.join(least, "a").where(b > a)
                 .select(b.alias("a"), F.col("least").alias("b")).where(a != b).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        tied = large.join(least, "a").where(b != F.col("least")).select(
            b.alias("a"), F.col("least").alias("b"))
        edges = stored(
            tied.union(least.select("a", F.col("least").alias("b"))).distinct(), "links")
    roots = edges.select("b").distinct().select(b.alias("id"), b.alias("component_id"))
    return edges.select(a.alias("id"), b.alias("component_id")).union(roots)


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one link, to a node that has none."""
    counts = edges.groupBy("a").count()
    if not counts.where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()
