"""Reports on the registry, the search log and the stored points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters

# Fixed value: the dashboard leaves out the consistency check beyond so many active documents.
RECONCILED_DOCUMENTS = 200


def registry_counts(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count(F.lit(1)).alias("documents_total"), F.count_if("is_active").alias("documents_active"), F.countDistinct("document_id").alias("distinct_documents"))


def recent_latencies(logs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    stages = ("query_expansion", "embed_query", "hybrid_search", "rerank")
    recent = logs.where(filters.recent("created_at", as_of, hours))
    return recent.agg(*[F.avg(f"latency_{s}_ms").alias(f"avg_latency_{s}_ms") for s in stages], F.max("created_at").alias("last_search_at"))


def missing_in_store(registry: DataFrame, points: DataFrame) -> DataFrame:
    """Active (document_id, version) rows without one actual chunk."""
    stored = points.where(filters.actual()).select("document_id", "version").distinct()
    return registry.where("is_active").select("document_id", "version").join(stored, ["document_id", "version"], "left_anti")


def dashboard(registry: DataFrame, logs: DataFrame, points: DataFrame, as_of: Column) -> DataFrame:
    """One row of figures; mismatches is null where there are too many active documents to check."""
    counts = registry_counts(registry)
    searches = logs.agg(F.count(F.lit(1)).alias("search_logs_total"))
    stored = points.agg(F.count(F.lit(1)).alias("points_count"))
    missing = missing_in_store(registry, points).agg(F.count(F.lit(1)).alias("__m"))
    one = counts.join(searches).join(recent_latencies(logs, as_of)).join(stored).join(missing)  # one row each
    return one.withColumn("mismatches", F.when(F.col("documents_active") <= RECONCILED_DOCUMENTS, F.col("__m"))).drop("__m")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def document_ids(registry: DataFrame) -> DataFrame:
    return registry.select("document_id").distinct().orderBy("document_id")


def topic_names(topics: DataFrame) -> DataFrame:
    return topics.select("name").distinct().orderBy("name")


def newest_first(rows: DataFrame, *more: str, column: str = "created_at") -> DataFrame:
    return rows.orderBy(F.col(column).desc(), *more)
