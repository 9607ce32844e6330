"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage


def _smallest(links: DataFrame) -> DataFrame:
    """(u, v, m): links with the smallest of u and its neighbours v."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return links.join(least, "u")


def _signature(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (u, v); a component's name is its smallest node.

    Stars are made with a partial minimum per node and a join, so a node with very many links is
    no single task's work: adaptive execution splits it.  Rounds grow with the logarithm of the
    diameter; each is stored, so a lost executor costs one round at most.
    """
    now = cut_lineage(links.where("u <> v").select("u", "v").distinct())
    before = None
    while (state := _signature(now)) != before:
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        starred = _smallest(down)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            starred.select("u", F.col("m").alias("v"))
        )
        now = cut_lineage(small.where("u <> v").distinct())
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionAll(centres)
