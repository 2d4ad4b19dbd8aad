"""Query expansion: a model's sub-questions and rephrasings as query variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, strip_code_fence, strip_emphasis
from ..schemas import MAX_REPHRASINGS, MAX_SUB_QUESTIONS

ANSWER = "struct<variants:array<struct<sub_question:string,rephrasings:array<string>>>>"


def variants(query: Column, answer: Column) -> Column:
    """Ordered distinct variants of a parsed answer; the query itself where there are none."""
    capped = F.slice(answer.variants, 1, MAX_SUB_QUESTIONS)
    each = F.transform(capped, lambda v: F.concat(F.array(v.sub_question), F.slice(F.coalesce(v.rephrasings, F.array().cast("array<string>")), 1, MAX_REPHRASINGS)))
    found = F.array_distinct(F.filter(F.flatten(each), lambda x: x.isNotNull() & (strip(x) != "")))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(query))


def expand(queries: DataFrame, answer_col: str = "answer") -> DataFrame:
    """One row per variant of each query, with variant_id from 0, and how the expansion went.

    ``answer_col`` is the provider's JSON text, with or without a code fence and emphasis;
    null or unreadable text is a failure, which leaves the query as its only variant.
    """
    parsed = queries.withColumn("__a", F.from_json(strip_emphasis(strip_code_fence(answer_col)), ANSWER))
    ok = F.col("__a.variants").isNotNull()
    out = parsed.withColumn("expansion_status", F.when(ok, "ok").otherwise("fallback_unavailable"))
    out = out.withColumnRenamed("query", "original_query").withColumn("__v", F.when(ok, variants(F.col("original_query"), F.col("__a"))).otherwise(F.array("original_query")))
    keep = [c for c in out.columns if c not in ("__a", "__v", answer_col)]
    return out.select(*keep, F.posexplode("__v").alias("variant_id", "query"))
