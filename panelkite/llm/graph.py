"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkite.llm.tables import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is its smallest node.

    Loops and repeated links are harmless. Each round is written; a hub's links are spread over the tasks of its
    join and combined before the shuffle.
    """
    edges = scratch.write(links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v"), "edges")
    seen = None
    while True:
        wide = scratch.write(_large_star(edges), "large-star")
        scratch.drop(edges)
        edges = scratch.write(_small_star(wide), "small-star")
        scratch.drop(wide)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return scratch.write(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
