"""Named queries: documents ingested and searched through providers, all steps together.

Each turn of a conversation is a document, each benchmark item a query. The providers are
deterministic stand-ins that SQL can follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import service
from ..operators import filters
from ..providers import HalfQuery, LetterEmbedder, LongestReranker, QuoteEnricher
from ..session import fresh_path
from ..sources import bodies
from ..sources.tables import Snapshot
from . import corpus as c
from .preparation import CHUNKS_SQL, clean_sql, uuid5_sql
from .registry import register

_LETTERS = 26
_ingested: dict[tuple[str, str], tuple[Snapshot, service.Ingested]] = {}


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two versions each: the second, whose text is the turn, is the one that counts."""
    turns = c.table(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("authorial", "case_law", "federal_law")]), (n % 3 + 1).cast("int"))
    audience = F.element_at(F.array(F.lit("seeker"), F.lit("employer"), F.lit("both")), (F.col("conv_id") % 3 + 1).cast("int"))
    topics = F.when(F.col("turn") % 4 == 3, F.array("role")).otherwise(F.array().cast("array<string>"))
    docs = turns.select(
        F.concat_ws("/", "conv_id", "turn").alias("document_id"), F.lit("v2").alias("version"), kind.alias("category"), F.concat(F.lit("By "), "role").alias("source_title"),
        audience.alias("audience"), topics.alias("topics"), F.lit("2024-03-01").cast("date").alias("effective_date"), F.col("text").alias("raw_text"),
    )
    older = docs.withColumns({"version": F.lit("v1"), "raw_text": F.lit("before")})
    return docs.unionByName(older)


def _store(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, service.Ingested]:
    """Ingested once in an application, in two batches."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ingested:
        store = service.open_store(spark, fresh_path(spark, "turns"), 8)
        docs, day = _turns(spark, sf_dir), F.lit("2024-03-02").cast("date")
        of = (QuoteEnricher(), LetterEmbedder(_LETTERS), day)
        service.ingest(store, docs.where("version = 'v2'").withColumn("version", F.lit("v0")), *of, calls=(None, None))
        done = service.ingest(store, docs, *of, calls=(None, None))
        _ingested[key] = (store.begin(), done)
    return _ingested[key]


_REASON = "CASE WHEN trim(text) = '' THEN 'empty text' WHEN topic AND kind = 'federal_law' THEN 'topics not allowed for category' END"
_VECTOR = f"list_transform(range(0, {_LETTERS}), lambda i: (length(lower({{0}})) - length(replace(lower({{0}}), chr((97 + i)::INT), '')))::DOUBLE)"
_TURNS_SQL = f"""
turned AS (
  SELECT conv_id || '/' || turn AS id, turn, text, (['authorial', 'case_law', 'federal_law'])[(conv_id + turn) % 3 + 1] AS kind, (['seeker', 'employer', 'both'])[conv_id % 3 + 1] AS audience,
         turn % 4 = 3 AS topic, role FROM conversations),
judged AS (SELECT *, {_REASON} AS reason FROM turned),
sections AS (SELECT id, 0 AS section_index, {clean_sql('text')} AS text FROM judged WHERE reason IS NULL)"""
_STORED_SQL = f"""
made AS (SELECT id, n, chunk, 'T ' || substr(chunk, 1, 40) || '.' AS title, list_transform(range(0, 3), lambda i: 'Q ' || substr(chunk, (i * 20 + 1)::INT, 30) || '?') AS asked FROM chunks),
embedded AS (SELECT *, {_VECTOR.format("(title || chr(10) || chr(10) || chunk)")} AS own, list_transform(asked, lambda q: {_VECTOR.format('q')}) AS theirs FROM made),
points AS (
  SELECT {uuid5_sql("'chunk:' || id || ':v2:' || n")} AS chunk_id, id AS document_id, kind AS category, 'By ' || role AS source_title, audience,
         CASE WHEN topic THEN [role] ELSE []::VARCHAR[] END AS topics, 'v2' AS version, n AS chunk_index, NULL::VARCHAR AS section_number, id AS section_title,
         DATE '2024-03-01' AS effective_date, true AS is_actual, chunk AS text, title, asked, own, theirs
  FROM embedded JOIN judged USING (id))"""
_BASE = c.with_sql(_TURNS_SQL, CHUNKS_SQL, _STORED_SQL).replace("WITH", "WITH RECURSIVE", 1)


@register("ingested_points", _BASE + """
SELECT chunk_id, document_id, category, source_title, audience, topics, version, chunk_index, section_title, text, title AS synthetic_title, asked AS hypothetical_questions,
       list_sum(own) AS letters, list_sum(list_transform(theirs, lambda v: list_sum(v))) AS question_letters FROM points""")
def ingested_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored points after two ingests through providers."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    points = _store(spark, sf_dir)[0].read("points")
    return points.select(
        "chunk_id", "document_id", "category", "source_title", "audience", "topics", "version", "chunk_index", "section_title", "text", "synthetic_title", "hypothetical_questions",
        total("chunk_vector").alias("letters"), F.aggregate("question_vectors", F.lit(0.0), lambda s, v: s + total(v)).alias("question_letters"))


@register("ingested_registry", c.with_sql(_TURNS_SQL.rsplit("sections AS", 1)[0].rstrip().rstrip(",")) + """
SELECT id AS document_id, 'v2' AS version, true AS is_active FROM judged WHERE reason IS NULL
UNION ALL SELECT id, 'v1', false FROM judged WHERE reason IS NULL
UNION ALL SELECT id, 'v0', false FROM judged WHERE reason IS NULL""")
def ingested_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir)[0].read("registry").select("document_id", "version", "is_active")


@register("ingested_postings", _BASE + f""", counted AS (SELECT document_id, unnest({c.TOKENS.format('text')}) AS token FROM points)
SELECT document_id, token, count(*)::DOUBLE AS tf FROM counted GROUP BY ALL""")
def ingested_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term index that the ingests left behind."""
    return _store(spark, sf_dir)[0].read("postings").groupBy("document_id", "token").agg(F.sum("tf").alias("tf"))


@register("ingest_refusals", c.with_sql(_TURNS_SQL.rsplit("sections AS", 1)[0].rstrip().rstrip(",")) + """
SELECT id AS document_id, reason FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT id, reason FROM judged WHERE reason <> 'empty text'""")
def ingest_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir)[1].refused


_ASKED_SQL = f"""
wanted AS (SELECT item_id, text, (['seeker', 'employer', 'both', NULL])[item_id % 4 + 1] AS audience, CASE WHEN item_id % 3 = 0 THEN 'case_law' END AS category FROM benchmark WHERE item_id % 7 < 5),
halves AS (SELECT item_id * 2 AS query_id, text AS query, audience, category FROM wanted UNION ALL SELECT item_id * 2 + 1, substr(text, 1, length(text) // 2), audience, category FROM wanted),
queries AS (SELECT query_id, query, audience, NULL::VARCHAR AS topic, category, {_VECTOR.format('query')} AS vector FROM halves),
vectors AS (
  SELECT chunk_id, category, audience, topics, -1 AS ordinal, own AS v FROM points
  UNION ALL SELECT chunk_id, category, audience, topics, unnest([0, 1, 2]), unnest(theirs) FROM points)"""
_ANSWER_SQL = """
variants AS (SELECT query_id // 2 AS q, query_id % 2 AS variant, chunk_id, rank FROM fused),
merged AS (SELECT q, chunk_id, list_sum(list_transform(list_sort(list({'v': variant, 'r': rank})), lambda x: 1.0::DOUBLE / (60 + x.r))) AS score, min({'v': variant, 'r': rank}) AS first FROM variants GROUP BY ALL),
shown AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, first) AS rank FROM merged),
told AS (SELECT q, chunk_id, score, p.document_id, row_number() OVER (PARTITION BY q ORDER BY least(2500, length('[' || concat_ws(' | ', 'source_title=' || source_title, 'category=' || category, 'section_title=' || section_title,
  'effective_date=' || effective_date::VARCHAR, 'version=' || version) || ']' || chr(10) || text)) DESC, rank) AS position FROM shown JOIN points p USING (chunk_id))"""
_PARTS = (_TURNS_SQL, CHUNKS_SQL, _STORED_SQL, _ASKED_SQL, c.DENSE_SQL, c.POSTINGS_SQL, c.SPARSE_SQL, c.LANES_SQL, c.FUSED_SQL, _ANSWER_SQL)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    return c.table(spark, sf_dir, "benchmark").select(
        item.alias("query_id"), F.when(item % 7 == 6, " \n").when(item % 7 == 5, "12 ab").otherwise(F.col("text")).alias("query"),
        F.element_at(F.array(F.lit("seeker"), F.lit("employer"), F.lit("both"), F.lit(None)), (item % 4 + 1).cast("int")).alias("audience"),
        F.lit(None).cast("string").alias("topic"), F.when(item % 3 == 0, "case_law").alias("category"), F.lit(4).alias("top_k"),
    )


_answers: dict[tuple[str, str], service.Answers] = {}


def answers(spark: SparkSession, sf_dir: str) -> service.Answers:
    """Searched once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _answers:
        _answers[key] = search(spark, sf_dir)
    return _answers[key]


def forget() -> None:
    """Delete the answers that are kept; they are searched again when next asked for."""
    while _answers:
        _answers.popitem()[1].release()


def search(spark: SparkSession, sf_dir: str) -> service.Answers:
    return service.search(_store(spark, sf_dir)[0], asked(spark, sf_dir), HalfQuery(), LetterEmbedder(_LETTERS), LongestReranker())


@register("answered_queries", c.with_sql(*_PARTS).replace("WITH", "WITH RECURSIVE", 1) + " SELECT q AS query_id, position, chunk_id, round(score, 9) AS score, document_id FROM told WHERE position <= 4")
def answered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries expanded, embedded, searched in all lanes, fused over their variants and reranked through providers."""
    return answers(spark, sf_dir).results.select("query_id", "position", "chunk_id", F.round("score", 9).alias("score"), "document_id")


@register("answer_outcomes", c.with_sql(*_PARTS).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT item_id AS query_id, 'ok' AS expansion_status, CASE WHEN count(chunk_id) = 0 THEN 'no_candidates' ELSE 'ok' END AS rerank_status, count(chunk_id) AS results,
       CASE WHEN count(chunk_id) = 0 THEN 'empty' ELSE 'ok' END AS outcome FROM wanted LEFT JOIN told ON q = item_id AND position <= 4 GROUP BY item_id
UNION ALL SELECT item_id, 'ok', 'not_started', 0, 'error' FROM benchmark WHERE item_id % 7 = 5""")
def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).outcomes.select("query_id", "expansion_status", "rerank_status", "results", "outcome")


@register("search_errors", c.with_sql(*_PARTS).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT item_id AS query_id, 'error' AS outcome, 'empty vector' AS error, 'not_started' AS rerank_status, 0 AS results FROM benchmark WHERE item_id % 7 = 5
UNION ALL SELECT item_id, CASE WHEN count(chunk_id) = 0 THEN 'empty' ELSE 'ok' END, NULL, CASE WHEN count(chunk_id) = 0 THEN 'no_candidates' ELSE 'ok' END, count(chunk_id)
FROM wanted LEFT JOIN told ON q = item_id AND position <= 4 GROUP BY item_id""")
def search_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of which a variant can't be embedded are errors with their reason; the others are as they would be alone."""
    return answers(spark, sf_dir).outcomes.select("query_id", "outcome", "error", "rerank_status", "results")


@register("refused_queries", "SELECT item_id AS query_id, 'empty query' AS reason FROM benchmark WHERE item_id % 7 = 6")
def refused_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks refuse; no search is run for it."""
    judged = asked(spark, sf_dir).select("query_id", filters.request_problem().alias("reason"))
    return judged.where("reason is not null")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 1 of every turn anew, twice; updates that are blank or of another category than federal laws can't be."""
    turns = c.table(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    rows = turns.select(
        F.concat_ws("/", "conv_id", "turn").alias("document_id"), F.lit("1").alias("section_number"), F.lit("Section").alias("section_title"), F.element_at(F.array(F.lit("authorial"), F.lit("case_law"), F.lit("federal_law")), (n % 3 + 1).cast("int")).alias("category"),
        F.lit("Again").alias("source_title"), F.lit("both").alias("audience"), F.array().cast("array<string>").alias("topics"), F.when(n % 4 == 0, " ").otherwise(F.concat(F.lit("New "), "text")).alias("raw_text"),
    )
    version = lambda v, day: rows.withColumns({"version": F.lit(v), "effective_date": F.lit(day).cast("date")})
    return version("v4", "2024-05-01").unionByName(version("v3", "2024-04-01"))


_updated: dict[tuple[str, str], tuple[Snapshot, service.Ingested]] = {}


def _after_updates(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, service.Ingested]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _updated:
        before, _ = _store(spark, sf_dir)
        done = service.update_sections(before.store, _updates(spark, sf_dir), QuoteEnricher(), LetterEmbedder(_LETTERS), F.lit("2024-03-05").cast("date"), (None, None))
        _updated[key] = (before.store.begin(), done)
    return _updated[key]


_UPDATED_SQL = """
WITH again AS (SELECT conv_id || '/' || turn AS id, 'New ' || text AS text, (conv_id + turn) AS n FROM conversations),
good AS (SELECT * FROM again WHERE n % 3 = 2 AND n % 4 <> 0)"""


@register("updated_sections", _UPDATED_SQL + f"""
SELECT {uuid5_sql("'chunk:' || id || ':1:v3:0'")} AS chunk_id, id || ':1' AS parent_id, 'v3' AS version, text, false AS is_actual, DATE '2024-05-01' AS effective_until FROM good
UNION ALL SELECT {uuid5_sql("'chunk:' || id || ':1:v4:0'")}, id || ':1', 'v4', text, true, NULL FROM good""")
def updated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates of a section through providers: the earlier one is history."""
    points = _after_updates(spark, sf_dir)[0].read("points").where("section_number = '1'")
    return points.select("chunk_id", "parent_id", "version", "text", "is_actual", "effective_until")


@register("section_updates", _UPDATED_SQL + """
SELECT id AS document_id, v.v AS version, 1 AS chunks_count, NULL AS reason FROM good, (SELECT unnest(['v3', 'v4']) AS v) v
UNION ALL SELECT id, NULL, NULL, CASE WHEN n % 4 = 0 THEN 'empty text' ELSE 'section update not allowed for category' END FROM again, (SELECT unnest([3, 4]) AS v) v WHERE n % 4 = 0 OR n % 3 <> 2""")
def section_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the updates did, and why some were refused."""
    done = _after_updates(spark, sf_dir)[1]
    made = done.report.select("document_id", "version", "chunks_count", F.lit(None).cast("string").alias("reason"))
    return made.unionByName(done.refused.select("document_id", F.lit(None).cast("string").alias("version"), F.lit(None).cast("long").alias("chunks_count"), "reason"))


@register("search_responses", c.with_sql(*_PARTS).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT item_id AS query_id, coalesce(list(told.chunk_id ORDER BY position) FILTER (told.chunk_id IS NOT NULL), []) AS chunk_ids, coalesce(list(p.title ORDER BY position) FILTER (told.chunk_id IS NOT NULL), []) AS titles
FROM wanted LEFT JOIN told ON q = item_id AND position <= 4 LEFT JOIN points p USING (chunk_id) GROUP BY item_id
UNION ALL SELECT item_id, [], [] FROM benchmark WHERE item_id % 7 = 5""")
def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON bodies of the responses to JSON requests, read again."""
    rows = asked(spark, sf_dir)
    made = rows.select("query_id", F.to_json(F.struct("query", "audience", "topic", "category", "top_k")).alias("body"))
    requests, _ = service.read_requests(made)
    found = service.search(_store(spark, sf_dir)[0], requests, HalfQuery(), LetterEmbedder(_LETTERS), LongestReranker())
    chunks = F.from_json("response", "chunks array<struct<chunk_id: string, synthetic_title: string>>")
    return service.responses(found).select("query_id", chunks.alias("r")).select("query_id", F.col("r.chunks.chunk_id").alias("chunk_ids"), F.col("r.chunks.synthetic_title").alias("titles"))


@register("refused_bodies", """
SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN 'not a request' WHEN 1 THEN 'unknown audience' WHEN 2 THEN 'unknown category' END AS reason FROM benchmark WHERE item_id % 5 < 3""")
def refused_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies that can't be read, or name what doesn't exist."""
    kind = F.col("item_id") % 5
    made = F.to_json(F.struct(F.lit("q").alias("query"), F.when(kind == 1, "nobody").alias("audience"), F.when(kind == 2, "poems").alias("category")))
    given = c.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(kind == 0, "{no json").otherwise(made).alias("body"))
    return service.read_requests(given)[1]


_BODY_SQL = """
WITH turned AS (SELECT conv_id || '/' || turn AS id, turn, text, role, (conv_id + turn) % 8 AS n FROM conversations)"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as the body of an ingest request; some lack fields, hold other types or values, or are no objects."""
    turns = c.table(spark, sf_dir, "conversations")
    n = (F.col("conv_id") + F.col("turn")) % 8
    fields = F.struct(
        F.when(n != 1, F.concat_ws("/", "conv_id", "turn")).alias("document_id"), F.when(n == 2, "poems").otherwise("authorial").alias("category"), F.when(n != 3, F.col("text")).otherwise("").alias("raw_text"),
        F.col("role").alias("source_title"), F.when(n == 2, "nobody").otherwise("both").alias("audience"), F.when(n == 4, F.array(F.lit("t"), F.col("role"))).alias("topics"),
        F.lit("v1").alias("version"), F.when(n == 3, "2024-02-30").otherwise("2024-02-29").alias("effective_date"), F.lit(7).alias("other"))
    body = F.to_json(fields)
    odd = F.when(n == 5, F.regexp_replace(body, '"version":"v1"', '"version":5,"topics":"t"')).when(n == 6, "[1]").when(n == 7, F.substring(body, 2, 40)).otherwise(body)
    return turns.select(F.concat_ws("/", "conv_id", "turn").alias("request_id"), odd.alias("body"))


@register("ingest_bodies", _BODY_SQL + """
SELECT id AS document_id, 'authorial' AS category, text AS raw_text, role AS source_title, 'both' AS audience, CASE WHEN n = 4 THEN ['t', role] ELSE [] END AS topics, 'v1' AS version, DATE '2024-02-29' AS effective_date
FROM turned WHERE n IN (0, 4) AND text <> ''""")
def ingest_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies of ingest requests as documents."""
    return bodies.read_ingests(_bodies(spark, sf_dir))[0].drop("request_id")


@register("refused_ingests", _BODY_SQL + """
SELECT id AS request_id, CASE n WHEN 1 THEN ['document_id: missing'] || CASE WHEN text = '' THEN ['raw_text: empty'] ELSE [] END WHEN 2 THEN ['category: unknown'] || CASE WHEN text = '' THEN ['raw_text: empty'] ELSE [] END || ['audience: unknown']
       WHEN 3 THEN ['raw_text: empty', 'effective_date: not a date'] WHEN 5 THEN CASE WHEN text = '' THEN ['raw_text: empty'] ELSE [] END || ['version: not a string', 'topics: not a list of strings']
       WHEN 0 THEN ['raw_text: empty'] WHEN 4 THEN ['raw_text: empty'] ELSE ['not an object'] END AS problems
FROM turned WHERE n NOT IN (0, 4) OR text = ''""")
def refused_ingests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that can't be ingested, each with all its problems."""
    return bodies.read_ingests(_bodies(spark, sf_dir))[1]


@register("kept_frequencies", _BASE + f""", flat AS (SELECT chunk_id, unnest({c.TOKENS.format('text')}) AS token FROM points)
SELECT token, tf, count(*) AS n FROM (SELECT chunk_id, token, count(*)::DOUBLE AS tf FROM flat GROUP BY ALL) GROUP BY ALL""")
def kept_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks hold each token how often, as counted up and down by the ingests."""
    return _store(spark, sf_dir)[0].read("frequencies")
