"""The engine as a whole: documents in, answers out, over a versioned store.

Ingest: checks, sections, chunks, enrichment, vectors, points, postings and registry
rows, published as one version. Search: expansion, vectors, lanes, fusion within and over variants,
reranking, payload. What providers answer is stored before it is used, so that no plan asks
twice.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import strip
from .operators import chunking, enrichment, expansion, filters, fusion, index, lifecycle, rerank, sections
from .operators import search as lanes_of
from .operators.quantized import with_codes
from .providers import Embedder, Enricher, Expander, Reranker
from .publishing import publish
from .schemas import AUDIENCES, CATEGORIES, MAX_CHUNKS, MAX_RAW_CHARS, POINTS, QUESTIONS, REGISTRY, SEARCH_LOGS, TOP_K_DEFAULT
from .session import Scratch
from .sources.tables import BUCKET_BYTES, Snapshot, SnapshotStore, TableSpec

#: The tables of a store; those dealt out by document change together, frequencies are added up.
TABLES = {
    "points": TableSpec(POINTS, "document_id", bloom=("chunk_id",)),
    "registry": TableSpec(REGISTRY, "document_id"),
    "postings": TableSpec(index.POSTINGS, "document_id", index.POSTINGS_ORDER),
    "frequencies": TableSpec(index.FREQUENCIES, "token", index.FREQUENCIES_ORDER, sums="n"),
}


def open_store(spark: SparkSession, path: str, buckets: int = 64, bucket_bytes: int = BUCKET_BYTES) -> SnapshotStore:
    return SnapshotStore(spark, path, TABLES, buckets, bucket_bytes)


@dataclass(frozen=True)
class Ingested:
    """What an ingest did: (document_id, version, chunks_count, replaced_versions), and (document_id, reason) of what was refused.

    Both are stored until ``release``.
    """

    report: DataFrame
    refused: DataFrame
    scratch: Scratch

    def release(self) -> None:
        self.scratch.close()


def ingest(store: SnapshotStore, documents: DataFrame, enricher: Enricher, embedder: Embedder, as_of: Column, order: Column | None = None, calls: tuple[int | None, int | None] = (5, 3), max_chunks: int = MAX_CHUNKS) -> Ingested:
    """Ingest whole documents: (document_id, version, category, source_title, audience, topics, effective_date, raw_text).

    Refused, each as a whole: texts that are empty or over MAX_RAW_CHARS, topics where the
    category has none, nothing left after cleaning, more than ``max_chunks`` chunks, and documents
    with a chunk that could not be enriched or embedded. Of several versions of a document only the last, by ``order``
    or else by version, is chunked. If another writer publishes meanwhile, the stored
    tables are read again; providers are not.
    """
    with Scratch(store.spark, "ingest") as scratch:
        return _ingest(store, documents, enricher, embedder, as_of, order, calls, max_chunks, scratch.keep)


def _ingest(store: SnapshotStore, documents: DataFrame, enricher: Enricher, embedder: Embedder, as_of: Column, order: Column | None, calls: tuple[int | None, int | None], max_chunks: int, kept, batch: tuple[str, int] | None = None) -> Ingested:
    raw = F.col("raw_text")
    problem = F.when(strip(F.coalesce(raw, F.lit(""))) == "", "empty text").when(F.length(raw) > MAX_RAW_CHARS, "text too long").otherwise(filters.document_problem())
    checked = documents.withColumn("__problem", problem)
    refused = [checked.where("__problem is not null").select("document_id", F.col("__problem").alias("reason"))]
    good = checked.where("__problem is null").drop("__problem")
    by = [F.col("version").desc()] if order is None else [order.desc(), F.col("version").desc()]
    last = good.withColumn("__n", F.row_number().over(Window.partitionBy("document_id").orderBy(*by))).where("__n = 1").drop("__n")

    cut = sections.preprocess(last.select("document_id", "category", "raw_text")).join(last.select("document_id", "version", "source_title", "audience", "topics", "effective_date"), "document_id")
    chunks = kept(chunking.chunk_sections(cut))
    refused.append(last.join(chunks.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit("no chunks").alias("reason")))
    large = chunking.oversized_documents(chunks, max_chunks)
    refused.append(large.select("document_id", F.lit("too many chunks").alias("reason")))
    enriched, unanswered = enrichment.enrich_chunks(lifecycle.met_with(chunks, large.select("document_id"), "document_id", "left_anti"), enricher, calls[0], kept)
    embedded, unplaced = enrichment.embed_chunks(enriched, embedder, calls[1], kept)
    for failed in (unanswered, unplaced):
        refused.append(failed.select("document_id", F.col("error").alias("reason")))
    placed = embedded.withColumns({"date_added": as_of, "effective_until": F.lit(None).cast("date"), "is_actual": F.lit(True)})
    points = kept(with_codes(placed).select(*POINTS.fieldNames()))
    told = Scratch(store.spark, "ingested")
    out = told.keep(lifecycle.union_all(refused))

    now = F.current_timestamp()
    done = good.join(points.select("document_id").distinct(), "document_id", "left_semi")
    rows = done.select("document_id", "version", "category", "source_title", "audience", "topics", "effective_date", F.lit(True).alias("is_active"), now.alias("created_at"), now.alias("updated_at"), *([] if order is None else [order.alias("__order")]))
    rows = kept(rows)
    sequence = None if order is None else F.col("__order")
    once = points.groupBy("chunk_id").count().where("count > 1").isEmpty()  # sections without a number share ids

    def change(_: Snapshot, stored: dict[str, DataFrame]):
        after, registry, report = lifecycle.ingest_documents(stored["points"], stored["registry"], points, rows, order=sequence, settled=once)
        return after, {"registry": registry.select(*REGISTRY.fieldNames())}, report

    return Ingested(publish(store, points, rows, change, told.keep, batch, stored=True), out, told)


def update_sections(store: SnapshotStore, updates: DataFrame, enricher: Enricher, embedder: Embedder, as_of: Column, calls: tuple[int | None, int | None] = (5, 3)) -> Ingested:
    """Replace single sections: (document_id, section_number, section_title, version, category, source_title, audience, topics, effective_date, raw_text).

    The given text is the section; it is neither cleaned nor cut into sections. What it
    replaces stays as history that ends on the update's date; the registry is not touched.
    Several updates of a section count in order of date and version. The report has
    (document_id, section_number, parent_id, version, chunks_count, superseded_chunks), the
    refusals (document_id, section_number, reason); an update is refused as a whole.
    """
    with Scratch(store.spark, "sections") as scratch:
        return _update_sections(store, updates, enricher, embedder, as_of, calls, scratch.keep)


def _update_sections(store: SnapshotStore, updates: DataFrame, enricher: Enricher, embedder: Embedder, as_of: Column, calls: tuple[int | None, int | None], kept) -> Ingested:
    key = ["document_id", "section_number", "version"]
    raw = F.col("raw_text")
    problem = (
        F.when(strip(F.coalesce(raw, F.lit(""))) == "", "empty text").when(F.coalesce(F.col("section_number"), F.lit("")) == "", "no section number")
        .when(F.length(raw) > MAX_RAW_CHARS, "text too long").otherwise(filters.document_problem(section_update=True))
    )
    checked = updates.withColumn("__problem", problem)
    refused = [checked.where("__problem is not null").select("document_id", "section_number", F.col("__problem").alias("reason"))]
    latest = Window.partitionBy(*key).orderBy(F.col("effective_date").desc(), "raw_text")
    good = checked.where("__problem is null").drop("__problem").withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    chunks = chunking.chunk_sections(good.withColumnRenamed("raw_text", "text").withColumn("section_index", F.lit(0)))
    # providers refuse whole updates, so an update stands for a document there
    named = kept(chunks.withColumns({"__document": F.col("document_id"), "chunk_index": F.col("chunk_number_in_section"), "document_id": F.concat_ws(":", "parent_id", "version")}))
    enriched, unanswered = enrichment.enrich_chunks(named, enricher, calls[0], kept)
    embedded, unplaced = enrichment.embed_chunks(enriched, embedder, calls[1], kept)
    whose = named.select("document_id", F.col("__document").alias("of"), "section_number").distinct()
    for failed in (unanswered, unplaced):
        refused.append(failed.join(whose, "document_id").select(F.col("of").alias("document_id"), "section_number", F.col("error").alias("reason")))
    points = embedded.withColumns({"document_id": F.col("__document"), "date_added": as_of, "effective_until": F.lit(None).cast("date"), "is_actual": F.lit(True)})
    points = kept(with_codes(points).select(*POINTS.fieldNames()))
    told = Scratch(store.spark, "updated")
    out = told.keep(lifecycle.union_all(refused))
    made = points.groupBy("document_id", "section_number", "parent_id", "version").agg(F.count(F.lit(1)).alias("chunks_count"))

    def change(_: Snapshot, stored: dict[str, DataFrame]):
        after, old = lifecycle.ingest_sections(stored["points"], points)
        report = made.join(old.select("parent_id", F.size("replaced_ids").alias("superseded_chunks")), "parent_id", "left").fillna(0, ["superseded_chunks"])
        return after, {}, report

    return Ingested(publish(store, points, points, change, told.keep, stored=True), out, told)


@dataclass(frozen=True)
class Answers:
    """What a search found, stored until ``release``.

    results: (query_id, position, chunk_id, score, payload); outcomes: (query_id,
    expansion_status, rerank_status, results, outcome, error); refused: (query_id, reason);
    candidates: all fused chunks (query_id, chunk_id, score, rank); lanes: what was fused;
    variants: (query_id, variant_id, query); latencies: milliseconds of each stage for the
    whole batch; counts: its rows at each stage.
    """

    results: DataFrame
    outcomes: DataFrame
    refused: DataFrame
    candidates: DataFrame
    lanes: DataFrame
    variants: DataFrame
    latencies: dict[str, float]
    counts: dict[str, int]
    scratch: Scratch

    def release(self) -> None:
        self.scratch.close()


@dataclass
class _Watch:
    """Stage by stage wall time and counts; a stage ends where its result is stored, and is counted while it is written."""

    at: float = field(default_factory=time.perf_counter)
    spent: dict[str, float] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def stored(self, keep, df: DataFrame, stage: str | None, **counted: Column) -> DataFrame:
        seen = Observation()
        out = keep(df.observe(seen, *[F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(k) for k, x in counted.items()]) if counted else df)
        self.counts |= seen.get if counted else {}
        now = time.perf_counter()
        if stage:
            self.spent[stage], self.at = self.spent.get(stage, 0.0) + (now - self.at) * 1000, now
        return out


def search(stored: Snapshot, queries: DataFrame, expander: Expander, embedder: Embedder, reranker: Reranker, depths: lanes_of.Depths = lanes_of.Depths(), calls: int | None = None, in_flight: int = 1, quantized: bool = False) -> Answers:
    """Answer queries (query_id, query, audience, topic, category, top_k) from one version of a store.

    All fused candidates go to the reranker. A query of which a variant can't be embedded has the
    outcome ``error`` and the reason; the others are answered. ``calls`` bounds the tasks
    that ask a provider, ``in_flight`` the calls of a task at once. ``quantized``: chunks'
    vectors are scanned as codes; the answers are the same.
    """
    told = Scratch(stored.store.spark, "answers")
    with Scratch(stored.store.spark, "search") as scratch:
        return _search(stored, queries, expander, embedder, reranker, depths, calls, in_flight, quantized, scratch.keep, told)


def _search(stored: Snapshot, queries: DataFrame, expander: Expander, embedder: Embedder, reranker: Reranker, depths: lanes_of.Depths, calls: int | None, in_flight: int, quantized: bool, keep, told: Scratch) -> Answers:
    checked = queries.withColumn("__problem", filters.request_problem())
    refused = told.keep(checked.where("__problem is not null").select("query_id", F.col("__problem").alias("reason")))
    asked = checked.where("__problem is null").drop("__problem").withColumn("top_k", F.coalesce("top_k", F.lit(TOP_K_DEFAULT)))
    watch, one = _Watch(), F.lit(1)
    variants = watch.stored(told.keep, expansion.expand(enrichment.expand_queries(asked, expander, calls, in_flight)), "query_expansion", variants=one)
    placed = watch.stored(keep, enrichment.embed_queries(variants, embedder, calls, in_flight), "embed_query", unplaced=F.col("error").isNotNull())
    failed = placed.where("error is not null").groupBy("query_id").agg(F.min_by("error", "variant_id").alias("error"))
    good = placed.join(failed.select("query_id"), "query_id", "left_anti").drop("error")
    n = good.count()

    points, o = stored.read("points"), F.col("ordinal")
    found = lanes_of.lanes(points, stored.read("postings"), stored.read("frequencies"), good, depths, embedder.dims, n, quantized=quantized)
    lanes = watch.stored(told.keep, found, "hybrid_search", dense=o < 0, question=o.between(0, QUESTIONS - 1), sparse=o >= QUESTIONS)
    fused = watch.stored(told.keep, fusion.fuse_variants(fusion.rrf(lanes, "query_id", "variant_id"), "query_id"), "hybrid_search", fused=one)

    texts = fused.join(points, "chunk_id").select("query_id", "rank", rerank.shown(rerank.candidate_text()).alias("candidate"))
    judged = asked.join(failed.select("query_id"), "query_id", "left_anti")
    answered = watch.stored(keep, enrichment.rerank_candidates(judged, texts, reranker, calls, in_flight), "rerank")
    results = watch.stored(told.keep, rerank.assemble(rerank.rerank(answered, fused), points), None, results=one)
    went = variants.groupBy("query_id").agg(F.min("expansion_status").alias("expansion_status"))
    known = rerank.statuses(answered, fused).withColumn("error", F.lit(None).cast("string"))
    unknown = failed.select("query_id", F.lit("not_started").alias("rerank_status"), F.lit(0).cast("long").alias("results"), "error")
    status = known.unionByName(unknown).join(went, "query_id")
    outcomes = told.keep(status.withColumn("outcome", rerank.outcome(F.col("expansion_status"), F.col("rerank_status"), F.col("results"), F.col("error"))))
    return Answers(results, outcomes, refused, fused, lanes, variants.select("query_id", "variant_id", "query"), watch.spent, watch.counts, told)


def _listed(order: list[str], value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"])


def log_rows(answers: Answers, queries: DataFrame, at: Column) -> DataFrame:
    """A search's rows for the log: ``queries`` with request_id; latencies are those of the batch.

    Dense candidates are those of the chunks' vectors and then of their questions', variant
    by variant and lane by lane, as they came before fusion. A query that failed has no row.
    """
    pair = F.struct("chunk_id", "score")
    laned = lambda only: answers.lanes.where(only).groupBy("query_id").agg(_listed(["variant_id", "lane", "rank"], pair).alias("v"))
    told = answers.results.groupBy("query_id").agg(_listed(["position"], F.col("chunk_id")).alias("v"))
    columns = {
        "query_variants": (answers.variants.groupBy("query_id").agg(_listed(["variant_id"], F.col("query")).alias("v")), "array<string>"),
        "dense_candidates": (laned(F.col("ordinal") < QUESTIONS), CANDIDATES_TYPE),
        "sparse_candidates": (laned(F.col("ordinal") >= QUESTIONS), CANDIDATES_TYPE),
        "rrf_candidates": (answers.candidates.groupBy("query_id").agg(_listed(["rank"], pair).alias("v")), CANDIDATES_TYPE),
        "reranked_chunk_ids": (told, "array<string>"),
    }
    rows = queries.join(answers.outcomes.where("outcome <> 'error'").select("query_id", "expansion_status", F.col("rerank_status").alias("reranker_status")), "query_id")
    rows = rows.withColumnRenamed("expansion_status", "query_expansion_status").join(responses(answers), "query_id").withColumnRenamed("response", "final_response")
    for name, (values, kind) in columns.items():
        rows = rows.join(values.withColumnRenamed("v", name), "query_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    timed = rows.withColumns({f"latency_{k}_ms": F.lit(v) for k, v in answers.latencies.items()} | {"created_at": at})
    return timed.select(*SEARCH_LOGS.fieldNames())


CANDIDATES_TYPE = "array<struct<chunk_id:string,score:double>>"

#: The body of a search request.
REQUEST = "query string, audience string, topic string, category string, top_k int"


def read_requests(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Requests (query_id, query, ...) from JSON bodies (query_id, body), and (query_id, reason) of those that can't be read."""
    parsed = bodies.withColumn("__r", F.from_json(body, f"{REQUEST}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    unread = F.col("__r").isNull() | F.col("__r.__bad").isNotNull()
    bad = F.when(unread, "not a request").when(~F.coalesce(F.col("__r.audience").isin(*AUDIENCES), F.lit(True)), "unknown audience").when(~F.coalesce(F.col("__r.category").isin(*CATEGORIES), F.lit(True)), "unknown category")
    judged = parsed.withColumn("reason", bad)
    good = judged.where("reason is null").select("query_id", "__r.query", "__r.audience", "__r.topic", "__r.category", "__r.top_k")
    return good, judged.where("reason is not null").select("query_id", "reason")


def responses(answers: Answers) -> DataFrame:
    """(query_id, response): each answered query's chunks, best first, as the JSON body of a response."""
    fields = ("chunk_id", "text", "synthetic_title", "source_title", "audience", "topics", "category", "section_number", "section_title", "score")
    chunk = F.struct(*[F.col(f) for f in fields if f in answers.results.columns])
    listed = answers.results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", chunk.alias("chunk")))).alias("c"))
    rows = answers.outcomes.select("query_id").join(listed, "query_id", "left")
    body = F.to_json(F.struct(F.transform("c", lambda x: x["chunk"]).alias("chunks")), {"ignoreNullFields": "false"})
    return rows.select("query_id", F.when(F.col("c").isNull(), F.lit('{"chunks":[]}')).otherwise(body).alias("response"))
