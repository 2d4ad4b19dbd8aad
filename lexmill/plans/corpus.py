"""The corpus that the named queries run over, derived from the provided tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..operators.quantized import with_codes
from ..schemas import CATEGORIES, schema
from ..session import fresh_path
from ..sources.tables import Snapshot, SnapshotStore, TableSpec

DIMS = 64

#: What searches read: points with their vectors, the term index, and the queries.
STORED = {
    "points": TableSpec(schema(
        "doc_id bigint, chunk_id string, document_id string, parent_id string, category string, source_title string, audience string, topics array<string>, chunk_index int, version string,"
        " effective_date date, is_actual boolean, section_number string, section_title string, text string, chunk_vector array<float>, question_vectors array<array<float>>, chunk_code binary, chunk_scale double"), None),
    "postings": TableSpec(index.POSTINGS, "document_id", index.POSTINGS_ORDER),
    "frequencies": TableSpec(index.FREQUENCIES, "token", index.FREQUENCIES_ORDER, sums="n"),
    "queries": TableSpec(schema("query_id bigint, query string, audience string, topic string, category string, top_k int, vector array<float>"), "query_id"),
}
#: What of the term index is stored: all of it, or how many chunks hold each token how often.
COUNTS = "counts"
_stored: dict[tuple[str, str, bool | str], Snapshot] = {}


def stored(spark: SparkSession, sf_dir: str, terms: bool | str = True) -> Snapshot:
    """The corpus as stored tables, written when first asked for in an application: points and queries, and with ``terms`` the term index, or its counts alone."""
    key = (spark.sparkContext.applicationId, sf_dir, terms)
    if key not in _stored:
        if terms == COUNTS:
            now = stored(spark, sf_dir, terms=False)
            _stored[key] = now.commit({"frequencies": (index.counted(now.read("points")), None)})
        elif terms:
            now = stored(spark, sf_dir, terms=COUNTS)
            _stored[key] = now.commit({"postings": (index.indexed(now.read("points")), None)})
        else:
            store = SnapshotStore(spark, fresh_path(spark, "corpus"), STORED, 8)
            now = store.begin().commit({"points": (with_codes(points(spark, sf_dir)).select(*STORED["points"].schema.fieldNames()), None)})
            _stored[key] = now.commit({"queries": (queries(spark, sf_dir).select(*STORED["queries"].schema.fieldNames()), None)})
    return _stored[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """One chunk per document; four chunks make a document, two versions alternate."""
    docs = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 20
    category = F.when(kind == 0, "case_law").when(kind == 1, "authorial").when(kind <= 4, "other_npa").when(kind <= 8, "federal_law").otherwise("labor_code")
    audience = F.element_at(F.array(F.lit("seeker"), F.lit("employer"), F.lit("both")), (F.col("doc_id") % 3 + 1).cast("int"))
    number = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 5).cast("string"))
    document = F.concat(F.lit("d"), F.floor(F.col("doc_id") / 4).cast("string"))
    base = docs.select(
        F.col("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), document.alias("document_id"),
        F.when(number.isNotNull(), F.concat_ws(":", document, number)).otherwise(document).alias("parent_id"),
        category.alias("category"), F.concat(F.lit("Source "), "source").alias("source_title"), audience.alias("audience"), F.array("source").alias("topics"),
        (F.col("doc_id") % 4).cast("int").alias("chunk_index"), F.concat(F.lit("v"), (F.col("doc_id") % 2).cast("string")).alias("version"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).alias("effective_date"),
        (F.col("doc_id") % 11 != 0).alias("is_actual"), number.alias("section_number"), F.lit(None).cast("string").alias("section_title"), "text",
    )
    if not vectors:
        return base
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = stored.agg(F.max("vec_id") + 1).first()[0]
    own = stored.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("chunk_vector"))
    slots = base.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2) + (F.col("doc_id") % 3).cast("int"))).alias("j"))
    asked = slots.withColumn("vec_id", (F.col("doc_id") * 7 + 13 * (F.col("j") + 1)) % n).join(stored, "vec_id")
    questions = asked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "embedding"))), lambda x: x.embedding).alias("question_vectors"))
    return base.join(own, "doc_id", "left").join(questions, "doc_id", "left")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query: its text, a vector, and filters in all combinations of presence."""
    item = F.col("item_id")
    stored = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = stored.agg(F.max("vec_id") + 1).first()[0]
    audience = F.when(item % 4 == 1, "seeker").when(item % 4 == 2, "employer").when(item % 4 == 3, "both")
    category = F.when(item % 3 == 0, F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (item % 5 + 1).cast("int")))
    topic = F.when(item % 5 == 4, F.concat(F.lit("src"), (item % 20).cast("string")))
    asked = table(spark, sf_dir, "benchmark").select(item.alias("query_id"), F.col("text").alias("query"), audience.alias("audience"), topic.alias("topic"), category.alias("category"), (item % n).alias("vec_id"), F.lit(5).alias("top_k"))
    return asked.join(stored, "vec_id").drop("vec_id")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (document, version) of the points; every ninth document is inactive, some have no chunks."""
    rows = points(spark, sf_dir, vectors=False).groupBy("document_id", "version").agg(F.min("category").alias("category"), F.min("source_title").alias("source_title"), F.min("doc_id").alias("id"))
    ghosts = table(spark, sf_dir, "nation").select(F.concat(F.lit("ghost"), F.col("n_nationkey").cast("string")).alias("document_id"), F.lit("v0").alias("version"), F.lit("authorial").alias("category"), F.col("n_name").alias("source_title"), F.col("n_nationkey").cast("long").alias("id"))
    return rows.unionByName(ghosts).withColumn("is_active", F.col("id") % 9 != 0)


def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a search journal."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("request_id"), F.col("event_type").alias("query"), F.get_json_object("props", "$.page").alias("topic"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("value").alias("latency_query_expansion_ms"), (F.col("value") * 2).alias("latency_embed_query_ms"), (F.col("value") + 1).alias("latency_hybrid_search_ms"), F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("latency_rerank_ms"),
    )


POINTS_SQL = """
n_vec AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
points AS (
  SELECT doc_id, doc_id::VARCHAR AS chunk_id, 'd' || (doc_id // 4) AS document_id,
         'd' || (doc_id // 4) || CASE WHEN doc_id % 7 <> 0 THEN ':' || (doc_id % 5) ELSE '' END AS parent_id,
         CASE WHEN doc_id % 20 = 0 THEN 'case_law' WHEN doc_id % 20 = 1 THEN 'authorial' WHEN doc_id % 20 <= 4 THEN 'other_npa'
              WHEN doc_id % 20 <= 8 THEN 'federal_law' ELSE 'labor_code' END AS category,
         'Source ' || source AS source_title, (['seeker', 'employer', 'both'])[doc_id % 3 + 1] AS audience, [source] AS topics,
         (doc_id % 4)::INT AS chunk_index, 'v' || (doc_id % 2) AS version, DATE '2024-01-01' + (doc_id % 28)::INT AS effective_date,
         doc_id % 11 <> 0 AS is_actual, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 5)::VARCHAR END AS section_number, text
  FROM documents)"""

VECTORS_SQL = """
vectors AS (
  SELECT p.chunk_id, p.category, p.audience, p.topics, -1 AS ordinal, e.embedding::DOUBLE[] AS v
  FROM points p JOIN embeddings e ON e.vec_id = p.doc_id WHERE p.is_actual
  UNION ALL
  SELECT p.chunk_id, p.category, p.audience, p.topics, j.j AS ordinal, e.embedding::DOUBLE[] AS v
  FROM points p, (SELECT unnest(range(0, 5)) AS j) j, n_vec JOIN embeddings e ON e.vec_id = (p.doc_id * 7 + 13 * (j.j + 1)) % n_vec.n
  WHERE p.is_actual AND j.j < 3 + p.doc_id % 3)"""

QUERIES_SQL = """
queries AS (
  SELECT item_id AS query_id, b.text AS query, CASE item_id % 4 WHEN 1 THEN 'seeker' WHEN 2 THEN 'employer' WHEN 3 THEN 'both' END AS audience,
         CASE WHEN item_id % 5 = 4 THEN 'src' || (item_id % 20) END AS topic,
         CASE WHEN item_id % 3 = 0 THEN (['labor_code', 'case_law', 'federal_law', 'other_npa', 'authorial'])[item_id % 5 + 1] END AS category,
         e.embedding::DOUBLE[] AS vector
  FROM benchmark b, n_vec JOIN embeddings e ON e.vec_id = item_id % n_vec.n)"""

ADMITS_SQL = "(q.audience IS NULL OR p.audience = q.audience OR p.audience = 'both') AND (q.topic IS NULL OR list_contains(p.topics, q.topic)) AND (q.category IS NULL OR p.category = q.category)"

DENSE_SQL = f"""
dense AS (
  SELECT q.query_id, q.category AS q_category, p.chunk_id, p.category, p.ordinal, list_cosine_similarity(q.vector, p.v) AS score
  FROM vectors p JOIN queries q ON {ADMITS_SQL})"""

TOKENS = r"regexp_extract_all(replace(lower({0}), 'ё', 'е'), '[\pL\pN_]+')"

POSTINGS_SQL = f"""
postings AS (
  SELECT chunk_id, token, count(*)::DOUBLE AS tf FROM (SELECT chunk_id, unnest({TOKENS.format('text')}) AS token FROM points) GROUP BY ALL),
idf AS (
  SELECT token, count(*) AS n, round(ln(1 + ((SELECT count(*) FROM points) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM postings GROUP BY token)"""

SPARSE_SQL = f"""
terms AS (
  SELECT query_id, token, count(*)::DOUBLE AS q_tf FROM (SELECT query_id, unnest({TOKENS.format('query')}) AS token FROM queries) GROUP BY ALL),
sparse AS (
  SELECT q.query_id, q.category AS q_category, p.chunk_id, p.category, 5 AS ordinal, s.score
  FROM (SELECT t.query_id, o.chunk_id, sum(t.q_tf * o.tf * i.idf) AS score FROM terms t JOIN postings o USING (token) JOIN idf i USING (token) GROUP BY ALL) s
  JOIN points p ON p.chunk_id = s.chunk_id AND p.is_actual JOIN queries q ON q.query_id = s.query_id AND {ADMITS_SQL})"""

LANES_SQL = """
laned AS (
  SELECT *, q_category IS NULL AS balanced,
         CASE WHEN q_category IS NULL THEN list_position(['labor_code', 'case_law', 'federal_law', 'other_npa', 'authorial'], category) - 1 ELSE 0 END AS place
  FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse)),
numbered AS (
  SELECT *, CASE WHEN ordinal < 0 THEN place WHEN ordinal < 5 THEN 5 + place * 5 + ordinal ELSE 30 + place END AS lane,
         CASE WHEN ordinal < 0 THEN CASE WHEN balanced THEN 4 ELSE 20 END WHEN ordinal < 5 THEN CASE WHEN balanced THEN 2 ELSE 10 END
              ELSE CASE WHEN balanced THEN 4 ELSE 20 END END AS depth FROM laned),
lanes AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lane, query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM numbered) WHERE rank <= depth)"""

FUSED_SQL = """
summed AS (
  SELECT query_id, chunk_id, list_sum(list_transform(list_sort(list({'lane': lane, 'rank': rank})), lambda x: 1.0::DOUBLE / (60 + x.rank))) AS score,
         min({'lane': lane, 'rank': rank}) AS first FROM lanes GROUP BY ALL),
fused AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM summed)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",".join(parts)


SEARCH_PARTS = (POINTS_SQL, VECTORS_SQL, QUERIES_SQL, DENSE_SQL, POSTINGS_SQL, SPARSE_SQL, LANES_SQL)
