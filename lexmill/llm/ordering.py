"""Dealing rows out in the order of a key, without a second run of what comes before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import measured, store


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounds_of(keys: DataFrame, key: Column, parts: int) -> list:
    """At most ``parts - 1`` ascending split points of a numeric key, from a mergeable quantile sketch."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = keys.agg(F.percentile_approx(key, F.array(*[F.lit(x) for x in at]), 50 * parts).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_of(key: Column, bounds: list) -> Column:
    """The number of bounds at or below ``key``: the place of its range; a null key is in range 0."""
    if not bounds:
        return F.lit(0)
    below = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key))
    return F.when(key.isNull(), 0).otherwise(below).cast("int")


def numbered(df: DataFrame, order: list[Column], by: str | None = None, name: str = "ordered") -> DataFrame:
    """Stored rows of ``df`` plus place (from 0 in ascending ``order``) and n, both within each value of ``by``.

    ``order`` must be total up to equal rows and begin with ``by``, which is not null. Rows
    are dealt out by ranges of the order, so values of ``by`` with very many rows are dealt
    over several tasks. What each range holds before a row's is added from the
    ranges' counts: as many rows as there are ranges and values of ``by``.
    """
    dealt = df.repartitionByRange(parts_of(df), *order).sortWithinPartitions(*order)
    kept = store(dealt.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("__at", 33)
    group = F.lit(0) if by is None else F.col(by)
    runs = kept.groupBy(part.alias("__part"), group.alias("__by")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__count"))
    whole = Window.partitionBy("__by")
    before = F.coalesce(F.sum("__count").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.select("__part", "__by", (before - F.col("__first")).alias("__shift"), F.sum("__count").over(whole).alias("n"))
    joined = kept.withColumns({"__part": part, "__by": group}).join(measured(placed), ["__part", "__by"])
    return joined.withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__by", "__shift")
