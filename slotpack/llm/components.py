"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014).

Every step is an aggregation per node and a skew-safe lookup of its result, so a node that holds a
third of all links spreads over many tasks. Only whether a round was the last one reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotpack.llm.common import lookup, store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the stored ``links`` (one, two); root is the component's least node."""
    edges = store(_down(links), "edges")
    while not _stars(edges):
        edges = store(_down(_star(_both(edges))), "large")
        edges = store(_down(_star(edges, keep_link=True)), "small")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether no node has links both up and down, nor two links down: each component is a star around its least node."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("low").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return per.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def _down(links: DataFrame) -> DataFrame:
    """Distinct links (high, low) from the larger to the smaller node."""
    a, b = links.columns
    return (links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
            .where("high > low").distinct())


def _both(edges: DataFrame) -> DataFrame:
    """Each link in both directions, as (high, low) without an order."""
    return edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))


def _star(edges: DataFrame, keep_link: bool = False) -> DataFrame:
    """New links of one step.

    For links in both directions (large star): every larger neighbour of a node is linked to the least
    of the node and its neighbours. With ``keep_link`` (small star, links point downwards): every
    smaller neighbour, and the node itself, is linked to the least neighbour.
    """
    least = store(edges.groupBy("high").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("links")), "least")
    met = lookup(edges, least, ["high"], size="links")
    if keep_link:
        return met.select("low", "least").unionByName(least.select(F.col("high").alias("low"), "least"))
    return met.where("low > high").select("low", F.least("high", "least").alias("least"))
