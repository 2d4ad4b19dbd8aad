"""Enrichment and embedding of chunks through providers, all or nothing per document."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import embedding_text, strip, strip_code_fence, strip_emphasis
from ..providers import CircuitOpen, ContentError, Embedder, Enricher, Expander, ProviderError, RateLimiter, Reranker, Resilient, parsed
from ..schemas import LEAST_QUESTIONS, QUESTIONS
from .lifecycle import Met, met_with

ENRICHMENT = "struct<synthetic_title:string,hypothetical_questions:array<string>>"


def _text(value) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ContentError("no text")
    return value


def checked_enrichment(answer: str) -> str:
    """The answer itself; ValueError where it breaks the contract, so that the provider is asked again."""
    got = parsed(answer)
    title, questions = got.get("synthetic_title"), got.get("hypothetical_questions")
    if not isinstance(title, str) or not title:
        raise ValueError("no title")
    if not isinstance(questions, list) or not LEAST_QUESTIONS <= sum(isinstance(q, str) and bool(q.strip()) for q in questions) <= QUESTIONS:
        raise ValueError("wrong number of questions")
    return answer


def checked_expansion(answer: str) -> str:
    if not isinstance(parsed(answer).get("variants"), list):
        raise ValueError("no variants")
    return answer


#: The guard of each kind of provider in this worker process: tasks share its breaker.
_guards: dict[str, Resilient] = {}


def _provided(df: DataFrame, column: str, kind: T.DataType, provider, ask: Callable, partitions: int | None, check: Callable | None = None, in_flight: int = 1) -> DataFrame:
    """``df`` plus ``column`` and ``error``: the provider's answer per row, or why there is none.

    ``partitions`` bounds the tasks that ask at once, ``in_flight`` the calls of a task at
    once; answers are in the order of rows. A provider's ``rate`` (calls a second of the
    whole job, or None) is divided among the tasks, and one limiter serves a task's calls.
    ``check`` runs within the retries. A row's error is always its own: while the circuit is open a
    task waits, and a circuit that a provider keeps itself fails the task.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(column, kind), T.StructField("error", T.StringType())])
    rate, name = getattr(provider, "rate", None), f"{type(provider).__module__}.{type(provider).__qualname__}"
    if rate and not partitions:
        partitions = max(1, math.ceil(rate))  # a task has a call a second at least
    dealt = df.repartition(partitions) if partitions else df
    share = rate / partitions if rate else None

    def run(batches):
        guard = _guards.setdefault(name, Resilient())
        guard.limiter = RateLimiter(share) if share else None

        def call(row):
            try:
                return guard.call(ask, row, check=check), None
            except CircuitOpen:
                raise
            except ProviderError as e:
                return None, str(e)

        with ThreadPoolExecutor(in_flight) as pool:
            for rows in batches:
                given = list(pool.map(call, rows.itertuples(index=False))) if in_flight > 1 else [call(row) for row in rows.itertuples(index=False)]
                answers, errors = ([x[i] for x in given] for i in (0, 1))
                yield rows.assign(**{column: pd.Series(answers, dtype=object, index=rows.index), "error": pd.Series(errors, dtype=object, index=rows.index)})

    return dealt.mapInPandas(run, schema)


def parse_enrichment(df: DataFrame, column: str = "answer") -> DataFrame:
    """Checked title and questions of a JSON answer; ``problem`` says why it is refused.

    Blank questions are dropped first; then three to five must be left and the title not be empty.
    """
    parsed = df.withColumn("__e", F.from_json(strip_emphasis(strip_code_fence(column)), ENRICHMENT))
    questions = F.filter("__e.hypothetical_questions", lambda q: q.isNotNull() & (strip(q) != ""))
    out = parsed.withColumns({"synthetic_title": F.col("__e.synthetic_title"), "hypothetical_questions": questions})
    problem = (
        F.when(F.coalesce(F.col("synthetic_title"), F.lit("")) == "", "no title")
        .when(~F.coalesce(F.size("hypothetical_questions").between(LEAST_QUESTIONS, QUESTIONS), F.lit(False)), "wrong number of questions")
    )
    return out.withColumn("problem", problem).drop("__e")


def whole_documents(df: DataFrame, failed: str, few: Met = DataFrame.join) -> tuple[DataFrame, DataFrame]:
    """Rows of documents without any failure, and the failures: (document_id, failed chunk_index list, first error).

    ``few`` joins with what is mostly few rows: ``met_with`` where ``df`` is stored, so that it may be counted first.
    """
    bad = df.where(F.col(failed).isNotNull())
    report = bad.groupBy("document_id").agg(F.sort_array(F.collect_list("chunk_index")).alias("failed_chunks"), F.min_by(failed, "chunk_index").alias("error"))
    return few(df, bad.select("document_id").distinct(), "document_id", "left_anti").drop(failed), report


def _as_is(df: DataFrame) -> DataFrame:
    return df


def enrich_chunks(chunks: DataFrame, provider: Enricher, partitions: int | None = 5, keep: Callable[[DataFrame], DataFrame] = _as_is, in_flight: int = 1) -> tuple[DataFrame, DataFrame]:
    """Chunks with synthetic_title and hypothetical_questions, and the failed documents.

    ``keep`` stores what was read of the answers, so that both results come of one call a chunk.
    """
    answered = _provided(chunks, "answer", T.StringType(), provider, lambda row: provider.enrich(_text(row.text)), partitions, checked_enrichment, in_flight)
    parsed = keep(parse_enrichment(answered).withColumn("failure", F.coalesce("error", "problem")).drop("error", "problem", "answer"))
    return whole_documents(parsed, "failure", DataFrame.join if keep is _as_is else met_with)


def embed_chunks(chunks: DataFrame, provider: Embedder, partitions: int | None = 3, keep: Callable[[DataFrame], DataFrame] = _as_is, in_flight: int = 1) -> tuple[DataFrame, DataFrame]:
    """Chunks with chunk_vector and question_vectors (in the questions' order), and the failed documents."""
    listed = chunks.withColumn("__texts", F.concat(F.array(embedding_text("synthetic_title", "text")), "hypothetical_questions"))
    kind = T._parse_datatype_string("array<array<float>>")

    def ask(row):
        if row[-1] is None:
            raise ContentError("no questions")
        vectors = provider.embed([_text(t) for t in row[-1]])
        if any(len(v) != provider.dims for v in vectors):
            raise ContentError("a vector has another size")
        return vectors

    done = keep(_provided(listed, "__vectors", kind, provider, ask, partitions, in_flight=in_flight).drop("__texts"))
    good, report = whole_documents(done, "error", DataFrame.join if keep is _as_is else met_with)
    return good.withColumns({"chunk_vector": F.get("__vectors", F.lit(0)), "question_vectors": F.slice("__vectors", 2, QUESTIONS)}).drop("__vectors"), report


def embed_queries(queries: DataFrame, provider: Embedder, partitions: int | None = None, in_flight: int = 1) -> DataFrame:
    """Queries with their vector, or null and the error."""
    asked = queries.select(*[c for c in queries.columns if c != "query"], "query")
    return _provided(asked, "vector", T.ArrayType(T.FloatType()), provider, lambda row: provider.embed([_text(row[-1])])[0], partitions, in_flight=in_flight)


def expand_queries(queries: DataFrame, provider: Expander, partitions: int | None = None, in_flight: int = 1) -> DataFrame:
    """Queries with the provider's JSON answer; null where it failed."""
    asked = queries.select(*[c for c in queries.columns if c != "query"], "query")
    return _provided(asked, "answer", T.StringType(), provider, lambda row: provider.expand(_text(row[-1])), partitions, checked_expansion, in_flight).drop("error")


def rerank_candidates(queries: DataFrame, candidates: DataFrame, provider: Reranker, partitions: int | None = None, in_flight: int = 1) -> DataFrame:
    """(query_id, top_k, indices) for candidates (query_id, rank, candidate); null indices where the provider failed."""
    listed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "candidate"))).alias("c"))
    texts = F.transform(F.coalesce("c", F.expr("cast(array() as array<struct<rank:int,candidate:string>>)")), lambda x: x.candidate)
    asked = queries.select("query_id", "top_k", "query").join(listed, "query_id", "left").select("query_id", "top_k", "query", texts.alias("texts"))
    return _provided(asked, "indices", T.ArrayType(T.IntegerType()), provider, lambda row: provider.rerank(_text(row.query), list(row.texts), int(row.top_k)), partitions, in_flight=in_flight).select("query_id", "top_k", "indices")
