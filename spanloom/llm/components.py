"""Connected components of a written edge table, and the confirmed links that make them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import staged


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one other at most, and nothing hangs below a node that does."""
    below = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    above = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = below.unionByName(above).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``edges`` (``a``, ``b``): the smallest node it reaches.

    Rounds of two steps: every node's larger neighbours are hung below its smallest neighbour, then
    its smaller ones. Only minima are aggregated, so a node with very many edges is no large group.
    Both steps keep the components; the number of rounds grows with the logarithm of their size.
    """
    edges = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least-neighbours")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.distinct(), "large-star")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least-below")
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = staged(small.distinct(), "edges")
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return staged(found.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components")
