"""Distributed connected components by alternating large-star and small-star steps.

Each step is one aggregate (combined before its shuffle, so a node with very many
edges costs one row per task) and one join, in which such a node's edges are dealt over
several tasks; edges are stored between steps, so lost executors cost one step. Nodes
may be of any ordered type. O(log n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, heavy_keys, spread_join, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v): link the neighbours on one side of a node to its smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    counted = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("count"))
    heavy, least = heavy_keys(counted, "u", 2 * edges.count()), counted.drop("count")
    joined = spread_join(both.where("v > u") if large else both, least, "u", heavy, ("v",))
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one edge, to a centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per.where("out > 1 or out = 1 and into = 1").limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node.

    Null ends and self-links are ignored (a node with only those has no row);
    repeated and reversed edges count once; an empty edge list gives no rows.
    """
    x, y = F.col(a), F.col(b)
    now = store(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        half = store(_star(now, large=True), "edges")
        discard(now)
        now = store(_star(half, large=False), "edges")
        discard(half)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
