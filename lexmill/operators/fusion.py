"""Reciprocal Rank Fusion over ranked lanes, and over the fused lists of query variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the smoothing constant of the fusion.
RRF_K = 60


def rrf(ranked: DataFrame, *by: str, lane: str = "lane", rank: str = "rank", k: int = RRF_K) -> DataFrame:
    """(by, chunk_id, score, rank): the sum of 1 / (k + rank) over lanes, added in lane order.

    Ties (to 12 digits) go to the chunk that comes first in the lanes, by lane and then rank.
    """
    places = F.array_sort(F.collect_list(F.struct(F.col(lane).alias("lane"), F.col(rank).alias("rank"))))
    summed = ranked.groupBy(*by, "chunk_id").agg(places.alias("p"))

    def add(total: Column, x: Column) -> Column:
        return total + 1.0 / (k + x["rank"])

    scored = summed.select(*by, "chunk_id", F.aggregate("p", F.lit(0.0), add).alias("score"), F.get("p", F.lit(0)).alias("first"))
    order = Window.partitionBy(*by).orderBy(F.round("score", 12).desc(), "first.lane", "first.rank")
    return scored.withColumn("rank", F.row_number().over(order)).drop("first")


def fuse_variants(fused: DataFrame, *by: str, variant: str = "variant_id", k: int = RRF_K) -> DataFrame:
    """The second level: the variants' fused lists, in order of variant, fused by their ranks alone."""
    return rrf(fused, *by, lane=variant, k=k)
