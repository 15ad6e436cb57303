"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import staged


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, low): the smallest of each node's v."""
    return staged(edges.groupBy("u").agg(F.min("v").alias("low")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node that has a link.

    Each step joins edges with the smallest neighbour of a node, so a node with very
    many links is a skewed join key, not a group; the loop ends when the edges are stars.
    """
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()
        large = staged(large)
        small = large.join(_lowest(large), "u")
        small = small.select("u", F.col("low").alias("v")).unionByName(small.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")))
        edges = staged(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
