"""Named queries: versions, section history, registry, dashboard, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, filters, lifecycle
from ..sources.tables import retrieve
from . import corpus as c
from .registry import register

_P = c.with_sql(c.POINTS_SQL)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.points(spark, sf_dir, vectors=False).withColumn("effective_until", F.lit(None).cast("date"))


@register("filtered_points", _P + """
SELECT chunk_id FROM points WHERE is_actual AND audience IN ('seeker', 'both') AND list_contains(topics, 'src3') UNION ALL
SELECT chunk_id FROM points WHERE is_actual AND category = 'federal_law' UNION ALL
SELECT chunk_id FROM points WHERE parent_id = 'd5:1' AND is_actual AND version <> 'v1' UNION ALL
SELECT chunk_id FROM points WHERE document_id = 'd7' AND version = 'v0'""")
def filtered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata predicates: audience with both, topic, category, replaced section, document and version."""
    p = _points(spark, sf_dir)
    one = p.where(filters.actual() & filters.audience(F.lit("seeker")) & filters.topic(F.lit("src3")))
    two = p.where(filters.actual() & filters.category(F.lit("federal_law")))
    three = p.where(filters.replaced_section(F.lit("d5:1"), F.lit("v1")))
    four = p.where(filters.document(F.lit("d7"), F.lit("v0")))
    return lifecycle.union_all([x.select("chunk_id") for x in (one, two, three, four)])


@register("document_versions", _P + "SELECT document_id, list_sort(list(DISTINCT version)) AS versions FROM points GROUP BY document_id")
def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.versions(_points(spark, sf_dir))


@register("actual_chunk_counts", _P + "SELECT document_id, version, count_if(is_actual) AS actual_chunks FROM points GROUP BY ALL")
def actual_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.actual_chunk_counts(_points(spark, sf_dir))


@register("list_chunks", _P + "SELECT document_id, chunk_id, chunk_index, version, is_actual FROM points ORDER BY document_id, chunk_index, chunk_id")
def list_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.list_chunks(_points(spark, sf_dir)).select("document_id", "chunk_id", "chunk_index", "version", "is_actual")


@register("delete_document", _P + "SELECT chunk_id FROM points WHERE NOT (document_id = 'd3') AND NOT (document_id = 'd4' AND version = 'v1')")
def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole document deleted, twice, and one version of another."""
    once = lifecycle.delete_document(_points(spark, sf_dir), "d3")
    return lifecycle.delete_document(lifecycle.delete_document(once, "d3"), "d4", "v1").select("chunk_id")


@register("delete_labelled", _P + "SELECT chunk_id FROM points WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = c.table(spark, sf_dir, "labels").where("toxic = 1")
    return lifecycle.delete_matching(_points(spark, sf_dir), toxic, "doc_id").select("chunk_id")


# New revisions: every third document comes again as v2 with its chunks renumbered; its first chunk comes twice.
_NEW_SQL = """
incoming AS (
  SELECT (doc_id + 1000000)::VARCHAR AS chunk_id, document_id, 'v2' AS version, chunk_index + 10 AS chunk_index, text FROM points WHERE (doc_id // 4) % 3 = 0
  UNION ALL SELECT (doc_id + 1000000)::VARCHAR, document_id, 'v2', 99, 'last' FROM points WHERE (doc_id // 4) % 3 = 0 AND doc_id % 4 = 0),
latest AS (SELECT chunk_id, arg_max(document_id, chunk_index) AS document_id, arg_max(version, chunk_index) AS version, max(chunk_index) AS chunk_index, arg_max(text, chunk_index) AS text FROM incoming GROUP BY chunk_id)"""


def _revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(points, registry, new points, new registry rows)."""
    old = _points(spark, sf_dir)
    stored = old.select("chunk_id", "document_id", "version", "chunk_index", "text")
    again = old.where(F.floor(F.col("doc_id") / 4) % 3 == 0).withColumns({"chunk_id": (F.col("doc_id") + 1000000).cast("string"), "version": F.lit("v2"), "chunk_index": F.col("chunk_index") + 10})
    twice = again.where("doc_id % 4 = 0").withColumns({"chunk_index": F.lit(99), "text": F.lit("last")})
    new = again.unionByName(twice).select(*stored.columns)
    registry = c.registry(spark, sf_dir).select("document_id", "version", "source_title", "is_active", F.lit("old").alias("created_at"))
    rows = new.select("document_id", "version").distinct().select("document_id", "version", F.lit("New").alias("source_title"), F.lit(True).alias("is_active"), F.lit("new").alias("created_at"))
    return stored, registry, new, rows


@register("upsert_points", _P + "," + _NEW_SQL + """
SELECT chunk_id, document_id, version, chunk_index FROM points UNION ALL SELECT chunk_id, document_id, version, chunk_index FROM latest""")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New points put in by id; of two with one id the later chunk stays."""
    stored, _, new, _ = _revisions(spark, sf_dir)
    return lifecycle.upsert(stored, new, "chunk_id", order=F.col("chunk_index")).select("chunk_id", "document_id", "version", "chunk_index")


@register("ingest_documents", _P + "," + _NEW_SQL + """
SELECT chunk_id, document_id, version, chunk_index FROM points WHERE document_id NOT IN (SELECT document_id FROM latest)
UNION ALL SELECT chunk_id, document_id, version, chunk_index FROM latest""")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents replaced: their other versions are deleted."""
    after, _, _ = lifecycle.ingest_documents(*_revisions(spark, sf_dir))
    return after.select("chunk_id", "document_id", "version", "chunk_index")


_REGISTRY_SQL = """
registry AS (
  SELECT document_id, version, min(category) AS category, min(source_title) AS source_title, min(doc_id) % 9 <> 0 AS is_active FROM points GROUP BY document_id, version
  UNION ALL SELECT 'ghost' || n_nationkey, 'v0', 'authorial', n_name, n_nationkey % 9 <> 0 FROM nation)"""


@register("ingest_registry", c.with_sql(c.POINTS_SQL, _REGISTRY_SQL, _NEW_SQL) + """
SELECT document_id, version, source_title, is_active AND document_id NOT IN (SELECT document_id FROM latest) AS is_active, 'old' AS created_at FROM registry
UNION ALL SELECT DISTINCT document_id, 'v2', 'New', true, 'new' FROM latest""")
def ingest_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after it: new rows in, replaced versions inactive."""
    return lifecycle.ingest_documents(*_revisions(spark, sf_dir))[1]


@register("ingest_report", _P + "," + _NEW_SQL + """
SELECT i.document_id, 'v2' AS version, count(*) AS chunks_count, (SELECT list_sort(list(DISTINCT version)) FROM points p WHERE p.document_id = i.document_id) AS replaced_versions
FROM incoming i GROUP BY i.document_id""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.ingest_documents(*_revisions(spark, sf_dir))[2]


# Two new versions of every third document in one batch; the later one counts.
_TWICE_SQL = "again AS (SELECT DISTINCT document_id FROM points WHERE (doc_id // 4) % 3 = 0)"


def _two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stored, registry, new, rows = _revisions(spark, sf_dir)
    later = new.withColumns({"chunk_id": F.concat("chunk_id", F.lit("x")), "version": F.lit("v3")})
    return lifecycle.ingest_documents(stored, registry, new.unionByName(later), rows.unionByName(rows.withColumn("version", F.lit("v3"))))


@register("ingest_two_versions", c.with_sql(c.POINTS_SQL, _TWICE_SQL) + """
SELECT chunk_id, document_id, version FROM points WHERE document_id NOT IN (SELECT document_id FROM again)
UNION ALL SELECT DISTINCT (doc_id + 1000000) || 'x', document_id, 'v3' FROM points WHERE document_id IN (SELECT document_id FROM again)""")
def ingest_two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points after a batch with two versions of a document."""
    return _two_versions(spark, sf_dir)[0].select("chunk_id", "document_id", "version")


@register("ingest_two_versions_registry", c.with_sql(c.POINTS_SQL, _REGISTRY_SQL, _TWICE_SQL) + """
SELECT document_id, version, is_active AND document_id NOT IN (SELECT document_id FROM again) AS is_active FROM registry
UNION ALL SELECT document_id, 'v2', false FROM again UNION ALL SELECT document_id, 'v3', true FROM again""")
def ingest_two_versions_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after it: the earlier of the two is there and inactive."""
    return _two_versions(spark, sf_dir)[1].select("document_id", "version", "is_active")


@register("upsert_registry", c.with_sql(c.POINTS_SQL, _REGISTRY_SQL) + """
SELECT document_id, version, CASE WHEN version = 'v1' THEN 'Renamed' ELSE source_title END AS source_title, 'old' AS created_at FROM registry""")
def upsert_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a version written again keep the time at which they were created."""
    old = c.registry(spark, sf_dir).select("document_id", "version", "source_title", F.lit("old").alias("created_at"))
    new = old.where("version = 'v1'").withColumns({"source_title": F.lit("Renamed"), "created_at": F.lit("new")})
    return lifecycle.upsert(old, new, "document_id", "version", keep=("created_at",))


_UPDATES_SQL = "updates AS (SELECT parent_id, 'v1' AS version, max(effective_date) + 30 AS since FROM points WHERE section_number = '2' GROUP BY parent_id)"


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).where("section_number = '2'")
    return rows.groupBy("parent_id").agg(F.lit("v1").alias("version"), F.date_add(F.max("effective_date"), 30).alias("effective_date"))


@register("supersede_sections", c.with_sql(c.POINTS_SQL, _UPDATES_SQL) + """
SELECT chunk_id, p.is_actual AND NOT coalesce(p.version <> u.version, false) AS is_actual, CASE WHEN p.is_actual AND p.version <> u.version THEN u.since END AS effective_until
FROM points p LEFT JOIN updates u USING (parent_id)""")
def supersede_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections replaced by a newer version end on its date and stay as history."""
    return lifecycle.supersede_sections(_points(spark, sf_dir), _updates(spark, sf_dir)).select("chunk_id", "is_actual", "effective_until")


@register("supersede_twice", c.with_sql(c.POINTS_SQL, _UPDATES_SQL) + """
SELECT chunk_id, p.is_actual AND u.parent_id IS NULL AS is_actual, CASE WHEN p.is_actual AND u.parent_id IS NOT NULL THEN CASE WHEN p.version <> 'v1' THEN u.since ELSE u.since + 30 END END AS effective_until
FROM points p LEFT JOIN updates u USING (parent_id)""")
def supersede_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates of a section in one batch: each chunk ends with the first of another version."""
    one = _updates(spark, sf_dir)
    two = one.withColumns({"version": F.lit("v2"), "effective_date": F.date_add("effective_date", 30)})
    return lifecycle.supersede_sections(_points(spark, sf_dir), two.unionByName(one)).select("chunk_id", "is_actual", "effective_until")


@register("as_of_points", c.with_sql(c.POINTS_SQL, _UPDATES_SQL) + """
SELECT chunk_id FROM points p LEFT JOIN updates u USING (parent_id)
WHERE p.effective_date <= DATE '2024-02-10' AND (NOT (p.is_actual AND coalesce(p.version <> u.version, false)) OR DATE '2024-02-10' < u.since)""")
def as_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision that was in force on a day."""
    after = lifecycle.supersede_sections(_points(spark, sf_dir), _updates(spark, sf_dir))
    return lifecycle.as_of(after, F.lit("2024-02-10").cast("date")).select("chunk_id")


@register("ingest_sections", c.with_sql(c.POINTS_SQL) + """
SELECT parent_id, list_sort(list(chunk_id)) AS replaced_ids FROM points WHERE is_actual AND version <> 'v9' AND section_number = '3' GROUP BY parent_id""")
def ingest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunks each section update replaces."""
    old = _points(spark, sf_dir)
    new = old.where("section_number = '3'").withColumns({"chunk_id": F.concat(F.lit("n"), "chunk_id"), "version": F.lit("v9"), "effective_date": F.lit("2024-06-01").cast("date"), "is_actual": F.lit(True)})
    return lifecycle.ingest_sections(old, new)[1]


@register("mark_inactive", c.with_sql(c.POINTS_SQL, _REGISTRY_SQL) + "SELECT document_id, version, is_active AND NOT (version = 'v0' AND document_id NOT LIKE 'ghost%') AS is_active FROM registry")
def mark_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.registry(spark, sf_dir)
    return lifecycle.mark_inactive(rows, rows.where("version = 'v0' AND document_id NOT LIKE 'ghost%'")).select("document_id", "version", "is_active")


@register("keep_newest", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one key the one with the largest id."""
    rows = c.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return lifecycle.keep_newest(rows, "user_id", "event_type", by="event_id")


@register("retrieve_points", _P + "SELECT chunk_id, source_title, text FROM points WHERE doc_id IN (SELECT doc_id FROM labels)")
def retrieve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload by ids; ids that no point has are dropped."""
    ids = c.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("chunk_id"))
    return retrieve(_points(spark, sf_dir), ids, "source_title", "text")


@register("missing_in_store", c.with_sql(c.POINTS_SQL, _REGISTRY_SQL) + """
SELECT document_id, version FROM registry r WHERE is_active AND NOT EXISTS (SELECT 1 FROM points p WHERE p.is_actual AND p.document_id = r.document_id AND p.version = r.version)""")
def missing_in_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active registry rows without an actual chunk."""
    return analytics.missing_in_store(c.registry(spark, sf_dir), _points(spark, sf_dir))


_LOGS_SQL = """
logs AS (SELECT event_id::VARCHAR AS request_id, event_type AS query, json_extract_string(props, '$.page') AS topic, ts AS created_at, value,
         CASE WHEN user_id % 3 <> 0 THEN value END AS reranked FROM events)"""


@register("dashboard", c.with_sql(c.POINTS_SQL, _REGISTRY_SQL, _LOGS_SQL) + """
SELECT (SELECT count(*) FROM registry) AS documents_total, (SELECT count_if(is_active) FROM registry) AS documents_active, (SELECT count(DISTINCT document_id) FROM registry) AS distinct_documents,
       (SELECT count(*) FROM logs) AS search_logs_total, round(avg(value), 6) AS avg_latency_query_expansion_ms, round(avg(value * 2), 6) AS avg_latency_embed_query_ms,
       round(avg(value + 1), 6) AS avg_latency_hybrid_search_ms, round(avg(reranked), 6) AS avg_latency_rerank_ms, max(created_at)::VARCHAR AS last_search_at, (SELECT count(*) FROM points) AS points_count,
       CASE WHEN (SELECT count_if(is_active) FROM registry) <= 200 THEN (SELECT count(*) FROM registry r WHERE is_active AND NOT EXISTS (
         SELECT 1 FROM points p WHERE p.is_actual AND p.document_id = r.document_id AND p.version = r.version)) END AS mismatches
FROM logs WHERE created_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.dashboard(c.registry(spark, sf_dir), c.search_logs(spark, sf_dir), _points(spark, sf_dir), F.lit("2024-01-20 12:00:00").cast("timestamp"))
    rounded = {x: F.round(x, 6) for x in out.columns if x.startswith("avg_")}
    return out.withColumns(rounded | {"last_search_at": F.date_format("last_search_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")}).withColumn("last_search_at", F.regexp_replace("last_search_at", r"\.?0+$", ""))


@register("log_search", c.with_sql(_LOGS_SQL) + """
SELECT request_id, query, topic, created_at::VARCHAR AS created_at FROM logs
WHERE contains(lower(query), 'ur') OR contains(lower(request_id), 'ur') OR contains(lower(coalesce(topic, '')), 'ur') ORDER BY logs.created_at DESC, request_id""")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows that hold a substring, the newest first."""
    from ..functions.text import contains_text

    rows = c.search_logs(spark, sf_dir).where(contains_text(["query", "request_id", "topic"], "UR"))
    named = analytics.newest_first(rows, "request_id").select("request_id", "query", "topic", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))
    return named.withColumn("created_at", F.regexp_replace(F.regexp_replace("created_at", r"(\.\d*?)0+$", "$1"), r"\.$", ""))


@register("repeated_numbers", _P + "SELECT category, section_number, version, count(*) AS n FROM points GROUP BY ALL HAVING count(*) > 1")
def repeated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.repeated(_points(spark, sf_dir), "category", "section_number", "version")


@register("document_ids", c.with_sql(c.POINTS_SQL, _REGISTRY_SQL) + "SELECT DISTINCT document_id FROM registry ORDER BY 1")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.document_ids(c.registry(spark, sf_dir))


@register("topic_names", "SELECT DISTINCT source AS name FROM documents ORDER BY 1")
def topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.topic_names(c.table(spark, sf_dir, "documents").select(F.col("source").alias("name")))


@register("topics_backfill", _P + "SELECT chunk_id, [source_title] AS topics, topics[1] AS topic FROM points")
def topics_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single topic as a list, and the first of a list as a single topic."""
    return _points(spark, sf_dir).select("chunk_id", F.array("source_title").alias("topics"), F.get("topics", F.lit(0)).alias("topic"))


@register("refused_documents", _P + """
SELECT chunk_id, CASE WHEN len(topics) > 0 AND category NOT IN ('other_npa', 'case_law', 'authorial') THEN 'topics not allowed for category'
       WHEN category NOT IN ('labor_code', 'federal_law', 'other_npa') THEN 'section update not allowed for category' END AS reason FROM points""")
def refused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a section update of each chunk would be refused."""
    return _points(spark, sf_dir).select("chunk_id", filters.document_problem(section_update=True).alias("reason"))


@register("refused_requests", """
SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty query' WHEN turn % 23 NOT BETWEEN 1 AND 20 THEN 'top_k out of range' END AS reason FROM conversations""")
def refused_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each turn, taken as a search request, would be refused."""
    rows = c.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"), (F.col("turn") % 23).alias("top_k"))
    return rows.select("conv_id", "turn", filters.request_problem().alias("reason"))


@register("oversized_documents", _P + "SELECT document_id, count(*) AS chunks FROM points GROUP BY document_id HAVING count(*) > 3")
def oversized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.chunking import oversized_documents as oversized

    return oversized(_points(spark, sf_dir), 3)
