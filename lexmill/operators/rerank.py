"""Reranking: candidate texts and prompts, a model's indices mapped back, and the outcome of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BETWEEN, CANDIDATE_CHARS, LEAD, QUESTIONS


def candidate_text() -> Column:
    """A chunk led by its source, category, section and revision."""
    always = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    given = lambda c: F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    parts = [always("source_title"), always("category"), *[given(c) for c in ("section_number", "section_title", "effective_date", "version")]]
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]\n"), F.col("text"))


def shown(candidate: Column) -> Column:
    """What of a candidate, its head included, the model sees."""
    return F.substring(candidate, 1, CANDIDATE_CHARS)


def prompts(candidates: DataFrame, *by: str, query: str = "query") -> DataFrame:
    """(by, prompt): each query and its candidates, numbered by rank from 1, each cut to CANDIDATE_CHARS."""
    one = F.concat(F.lit('<candidate id="'), F.col("rank").cast("string"), F.lit('">'), shown(F.col("candidate")), F.lit("</candidate>"))
    listed = F.array_sort(F.collect_list(F.struct("rank", one.alias("x"))))
    grouped = candidates.groupBy(*by).agg(F.first(query).alias("__q"), F.array_join(F.transform(listed, lambda c: c.x), BETWEEN).alias("__c"))
    return grouped.select(*by, F.concat(F.lit(LEAD[0]), "__q", F.lit(LEAD[1]), "__c").alias("prompt"))


def valid_indices(indices: Column, n: Column, top: Column) -> Column:
    """Indices from 1 to ``n``, each once, in the given order, and then the first ``top``."""
    return F.slice(F.array_distinct(F.filter(indices, lambda i: i.between(1, n))), 1, top)


def _judged(queries: DataFrame, fused: DataFrame, answer_col: str) -> DataFrame:
    """The fused rows with top_k, rerank_status and position (null: not in the result); a query has few of them."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id")).cast("int")
    rows = fused.withColumn("n", n).join(queries.select("query_id", "top_k", F.col(answer_col).alias("__given")), "query_id")
    rows = rows.withColumn("picked", valid_indices(F.col("__given"), F.col("n"), F.col("top_k")))
    status = (
        F.when(F.col("__given").isNull(), "fallback_unavailable").when(F.size("__given") == 0, "no_relevant")
        .when(F.size("picked") == 0, "fallback_invalid_output").otherwise("ok")
    )
    rows = rows.withColumn("rerank_status", status)
    position = F.when(F.col("rerank_status").startswith("fallback"), F.col("rank")).when(F.col("rerank_status") == "ok", F.array_position("picked", F.col("rank").cast("int"))).cast("int")
    return rows.withColumn("position", F.when((position >= 1) & (position <= F.col("top_k")), position))


def rerank(queries: DataFrame, fused: DataFrame, answer_col: str = "indices") -> DataFrame:
    """(query_id, chunk_id, score, position, rerank_status): the final order of each query's candidates.

    ``queries`` has query_id, top_k and the model's answer: null is a failure and keeps
    the fused order; no index at all means that nothing is relevant; only invalid ones keep the
    fused order. ``fused`` has (query_id, chunk_id, score, rank).
    """
    return _judged(queries, fused, answer_col).where("position is not null").select("query_id", "chunk_id", "score", "position", "rerank_status")


def statuses(queries: DataFrame, fused: DataFrame, answer_col: str = "indices") -> DataFrame:
    """(query_id, rerank_status, results) of every query, also of those without results."""
    per = _judged(queries, fused, answer_col).groupBy("query_id").agg(F.first("rerank_status").alias("s"), F.count("position").alias("r"))
    return queries.join(per, "query_id", "left").select("query_id", F.coalesce("s", F.lit("no_candidates")).alias("rerank_status"), F.coalesce("r", F.lit(0)).alias("results"))


def outcome(expansion: Column, rerank_status: Column, results: Column, error: Column | None = None) -> Column:
    """error where there is one, degraded after any fallback, empty without results, else ok."""
    if error is not None:
        return F.when(error.isNotNull(), "error").otherwise(outcome(expansion, rerank_status, results))
    fell = F.coalesce(expansion.startswith("fallback"), F.lit(False)) | F.coalesce(rerank_status.startswith("fallback"), F.lit(False))
    return F.when(fell, "degraded").when(results == 0, "empty").otherwise("ok")


def assemble(final: DataFrame, points: DataFrame) -> DataFrame:
    """The final rows with their payload, joined last; ids that no point has are dropped."""
    kept = ("chunk_id", "document_id", "category", "source_title", "audience", "topics", "version", "section_number", "section_title", "synthetic_title", "text")
    return final.join(points.select(*[c for c in kept if c in points.columns]), "chunk_id")


def trace(lanes: DataFrame, fused: DataFrame, final: DataFrame) -> DataFrame:
    """Rows (n) per query and stage of the search; each table is counted in one pass."""
    o = F.col("ordinal")
    kind = F.when(o < 0, "dense").when(o < QUESTIONS, "question").otherwise("sparse")
    staged = [lanes.select("query_id", kind.alias("stage")), fused.select("query_id", F.lit("fused").alias("stage")), final.select("query_id", F.lit("final").alias("stage"))]
    return staged[0].unionByName(staged[1]).unionByName(staged[2]).groupBy("query_id", "stage").agg(F.count(F.lit(1)).alias("n"))
