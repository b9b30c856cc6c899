"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import Steps


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it instead."""
    around = _both(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them instead."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is linked to one node only, and that one to none smaller."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return seen.where("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """(node, root): the smallest node each linked node reaches, for links (u, v) of whole numbers.

    Every round is an aggregate and a join on the node, so a hub is combined
    before the shuffle or split by the join; the number of rounds grows with the
    logarithm of the longest path. Rounds end when no node that is linked to is itself linked on.
    """
    edges = steps.write("stars-0", links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    turn = 0
    while not _are_stars(edges):
        turn += 1
        edges = steps.write(f"stars-{turn}", _small_star(_large_star(edges)))
        steps.drop(f"stars-{turn - 1}")
    # Now every edge leads to the smallest node of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
