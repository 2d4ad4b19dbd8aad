"""Named queries: cleaning, sections, chunks, enrichment contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, enrichment, sections
from . import corpus as c
from .registry import register

_SPACE = r"[\t-\r\x1c-\x20\x{85}\pZ]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


# The cleaning rules as SQL patterns.
_RULES = (r"(?m)^\s*-?\s*\d+\s*-?\s*$", r"(?m)^ЧАСТЬ\s+\S+\s*$", r"(?m)^Раздел\s+[IVXLCDM]+\.\s*.*$", r"(?m)^Глава\s+\d+\.\s*.*$")


def clean_sql(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '-\\n([\\pL\\pN_])', '\\1', 'g')"
    for rule in _RULES:
        out = f"regexp_replace({out}, '{rule}', '', 'g')"
    return _strip(f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_CLEAN = clean_sql("text")

# Every third line of a document becomes a heading of the given form.
_LINES = "lines AS (SELECT doc_id, 'd' || doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE {})"


def _headed(docs: DataFrame, heading) -> DataFrame:
    """(document_id, text): documents whose lines 0, 3, 6, ... are led by a heading line."""
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(heading(i), F.lit("\n"), x)).otherwise(x))
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.array_join(marked, "\n").alias("text"))


@register("clean_text", f"SELECT doc_id, {_CLEAN} AS cleaned FROM (SELECT doc_id, text || chr(10) || '12' || chr(10) || chr(10) || chr(10) || 'Глава 3. Общие' || chr(10) || 'конец- ' AS text FROM documents)")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning of every text, with a page number and a chapter heading added."""
    docs = c.table(spark, sf_dir, "documents")
    tail = F.lit("\n12\n\n\nГлава 3. Общие\nконец- ")
    return docs.select("doc_id", text.clean_text(F.concat("text", tail)).alias("cleaned"))


@register("normalized_terms", f"SELECT doc_id, {c.TOKENS.format('text')} AS tokens FROM documents")
def normalized_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized tokens in order."""
    return c.table(spark, sf_dir, "documents").select("doc_id", text.tokens("text").alias("tokens"))


def _headed_lines(where: str = "true") -> str:
    return f"{_LINES.format(where)}, numbered AS (SELECT *, i // 3 AS s, (i - i % 3) % 5 AS number FROM lines)"


_LAW_SQL = f"""
law_parts AS (SELECT document_id, s, number, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS body FROM numbered GROUP BY ALL),
law AS (SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY min(s)) - 1)::INT AS section_index, number::VARCHAR AS section_number,
       'Статья ' || number || '. Заголовок' AS section_title, coalesce(string_agg(body, chr(10) ORDER BY s) FILTER (body <> ''), '') AS text
FROM law_parts GROUP BY document_id, number)"""
_POINTS_SQL = f"""
point_parts AS (SELECT document_id, s, {_strip("(s * 3 + 1) || '. Пункт' || chr(10) || string_agg(line, chr(10) ORDER BY i)")} AS body FROM numbered GROUP BY document_id, s),
points_cut AS (SELECT document_id, s::INT AS section_index, (s * 3 + 1)::VARCHAR AS section_number, (s * 3 + 1) || '. Пункт' AS section_title, body AS text FROM point_parts)"""
_TITLES_SQL = f"""
titles AS (SELECT document_id, s::INT AS section_index, NULL::VARCHAR AS section_number, 'Title ' || (s * 3) AS section_title, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS text
FROM numbered GROUP BY document_id, s)"""
_law_heading = lambda i: F.concat(F.lit("Статья "), (i % 5).cast("string"), F.lit(". Заголовок"))
_point_heading = lambda i: F.concat((i + 1).cast("string"), F.lit(". Пункт"))
_title_heading = lambda i: F.concat(F.lit("## Title "), i.cast("string"))


@register("law_sections", c.with_sql(_headed_lines(), _LAW_SQL) + " SELECT * FROM law")
def law_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with repeated numbers, whose texts join their first occurrence."""
    docs = _headed(c.table(spark, sf_dir, "documents"), _law_heading)
    return sections.law_sections(docs.withColumn("category", F.lit("labor_code"))).drop("category")


@register("point_sections", c.with_sql(_headed_lines(), _POINTS_SQL) + " SELECT * FROM points_cut")
def point_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered points; the heading stays in the text."""
    docs = _headed(c.table(spark, sf_dir, "documents"), _point_heading)
    return sections.point_sections(docs.withColumn("category", F.lit("other_npa"))).drop("category")


@register("heading_sections", c.with_sql(_headed_lines(), _TITLES_SQL) + " SELECT * FROM titles")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown headings."""
    docs = _headed(c.table(spark, sf_dir, "documents"), _title_heading)
    return sections.heading_sections(docs.withColumn("category", F.lit("authorial"))).drop("category")


# Each document gets headings of the form that its category's structure looks for; every seventh has none.
_KIND_SQL = "CASE WHEN doc_id % 7 = 6 THEN 'none' WHEN doc_id % 20 > 4 THEN 'law' WHEN doc_id % 20 = 1 THEN 'titles' ELSE 'points' END"
_PREPROCESS_SQL = c.with_sql(
    "texts AS (SELECT doc_id, 'd' || doc_id AS document_id, text, " + _KIND_SQL + " AS kind FROM documents)",
    f"cleaned AS (SELECT doc_id, document_id, kind, {_CLEAN} AS text FROM texts)",
    "lines AS (SELECT doc_id, document_id, kind, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM cleaned)",
    "numbered AS (SELECT *, i // 3 AS s, (i - i % 3) % 5 AS number FROM lines)", _LAW_SQL, _POINTS_SQL, _TITLES_SQL,
) + """
SELECT x.* FROM law x JOIN texts USING (document_id) WHERE kind = 'law' UNION ALL
SELECT x.* FROM points_cut x JOIN texts USING (document_id) WHERE kind = 'points' UNION ALL
SELECT x.* FROM titles x JOIN texts USING (document_id) WHERE kind = 'titles' UNION ALL
SELECT document_id, 0, NULL, document_id, text FROM cleaned WHERE kind = 'none'"""


@register("preprocess", _PREPROCESS_SQL)
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned and cut by the structure of their category, in one pass."""
    points = c.points(spark, sf_dir, vectors=False).withColumn("text", text.clean_text("text"))
    lines, n = F.split("text", "\n"), F.col("doc_id")
    heading = lambda i: F.when(n % 20 > 4, _law_heading(i)).when(n % 20 == 1, _title_heading(i)).otherwise(_point_heading(i))
    marked = F.array_join(F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(heading(i), F.lit("\n"), x)).otherwise(x)), "\n")
    docs = points.select(F.concat(F.lit("d"), n.cast("string")).alias("document_id"), "category", F.when(n % 7 == 6, F.col("text")).otherwise(marked).alias("raw_text"))
    return sections.preprocess(docs).drop("category")


@register("section_report", c.with_sql(c.POINTS_SQL) + """
SELECT document_id, sum(n)::BIGINT AS sections, coalesce(sum(n) FILTER (section_number LIKE '%.%'), 0)::BIGINT AS dotted,
       coalesce(sum(n) FILTER (section_number NOT LIKE '%.%' AND length(section_number) > 3), 0)::BIGINT AS suspicious, count_if(n > 1) AS repeated
FROM (SELECT document_id, CASE WHEN doc_id % 3 = 0 THEN section_number || '.5' WHEN doc_id % 3 = 1 THEN section_number || '000' ELSE '7' END AS section_number, count(*) AS n FROM points GROUP BY ALL)
GROUP BY document_id""")
def section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections per document, dotted and suspicious numbers, and how many numbers come again."""
    number, n = F.col("section_number"), F.col("doc_id") % 3
    made = F.when(n == 0, F.concat(number, F.lit(".5"))).when(n == 1, F.concat(number, F.lit("000"))).otherwise("7")
    return sections.section_report(c.points(spark, sf_dir, vectors=False).select("document_id", made.alias("section_number")))


@register("estimated_tokens", "SELECT doc_id, (length(text) // 4)::INT AS tokens, length(text) > 2000000 AS too_long FROM documents")
def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..schemas import MAX_RAW_CHARS

    return c.table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens("text").alias("tokens"), (F.length("text") > MAX_RAW_CHARS).alias("too_long"))


@register("document_lines", f"""
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS lines,
       list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\\n\\s*\\n+'), lambda x: {_strip('x')}), lambda x: x <> '') AS paragraphs FROM documents""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, and paragraphs of the text with its sentences set apart."""
    apart = F.replace("text", F.lit(". "), F.lit(".\n \n"))
    return c.table(spark, sf_dir, "documents").select("doc_id", chunking.split_lines(F.col("text")).alias("lines"), chunking.split_paragraphs(apart).alias("paragraphs"))


@register("pack_units", f"""
WITH RECURSIVE units AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS u FROM documents),
packed(doc_id, i, n, tokens) AS (
  SELECT doc_id, 1, 0, length(u[1]) // 4 FROM units WHERE len(u) > 0
  UNION ALL
  SELECT p.doc_id, i + 1, CASE WHEN tokens + length(u[i + 1]) // 4 > 500 THEN n + 1 ELSE n END,
         CASE WHEN tokens + length(u[i + 1]) // 4 > 500 THEN length(u[i + 1]) // 4 ELSE tokens + length(u[i + 1]) // 4 END
  FROM packed p JOIN units USING (doc_id) WHERE i < len(u))
SELECT doc_id, n AS number, string_agg(u[i], chr(10) || chr(10) ORDER BY i) AS chunk FROM packed JOIN units USING (doc_id) GROUP BY doc_id, n""")
def pack_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into chunks of at most 500 estimated tokens."""
    docs = c.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.pack(chunking.split_lines(F.col("text")))).alias("number", "chunk"))


def _lines_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"


def _paragraphs_sql(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\n\\s*\\n+'), lambda x: {_strip('x')}), lambda x: x <> '')"


def _cut_sql(x: str) -> str:
    lines, paragraphs = _lines_sql(x), _paragraphs_sql(x)
    return f"CASE WHEN length({x}) // 4 <= 500 THEN [{x}] WHEN len({paragraphs}) > 1 THEN {paragraphs} WHEN len({lines}) > 1 THEN {lines} ELSE [{x}] END"


# From sections (id, section_index, text) to chunks (id, section_index, n, chunk). ends[i + 1]: characters of the first
# i words with a space after each. A window reaches as far as 2003 characters, the next one starts within its last 400;
# one that brings less than 664 new characters joins the window before it.
CHUNKS_SQL = f"""
once AS (SELECT id, section_index, unnest(u) AS u, unnest(range(0, len(u))) AS p FROM (SELECT id, section_index, {_cut_sql('text')} AS u FROM sections)),
twice AS (SELECT id, section_index, p, unnest(v) AS v, unnest(range(0, len(v))) AS q FROM (SELECT id, section_index, p, {_cut_sql('u')} AS v FROM once)),
words AS (SELECT id, section_index, p, q, regexp_extract_all(v, '[^{_SPACE[1:]}+') AS w FROM twice WHERE length(v) // 4 > 500),
ended AS (SELECT id, section_index, p, q, w, [0] || list_transform(range(1, len(w) + 1), lambda i: i) AS places,
          (SELECT list(e ORDER BY i) FROM (SELECT i, sum(size) OVER (ORDER BY i) AS e FROM (SELECT unnest(range(0, len(w) + 1)) AS i, unnest([0] || list_transform(w, lambda x: length(x) + 1)) AS size))) AS ends FROM words WHERE len(w) > 0),
windows(id, section_index, p, q, n, a, stop, start) AS (
  SELECT id, section_index, p, q, 0, 0, s, CASE WHEN b > 0 THEN b ELSE s END FROM (
    SELECT *, len(list_filter(ends, lambda x: x <= ends[s + 1] - 400)) - 1 AS b FROM (SELECT *, greatest(1, len(list_filter(ends, lambda x: x <= 2003)) - 1) AS s FROM ended))
  UNION ALL
  SELECT id, section_index, p, q, CASE WHEN joins THEN n ELSE n + 1 END, CASE WHEN joins THEN a ELSE start END, s, CASE WHEN b > start THEN b ELSE s END FROM (
    SELECT *, ends[s + 1] - ends[stop + 1] < 664 AS joins, len(list_filter(ends, lambda x: x <= ends[s + 1] - 400)) - 1 AS b FROM (
      SELECT t.*, ends, greatest(start + 1, len(list_filter(ends, lambda x: x - ends[start + 1] <= 2003)) - 1) AS s
      FROM windows t JOIN ended e USING (id, section_index, p, q) WHERE t.stop < len(e.w)))),
spans AS (SELECT id, section_index, p, q, n, min(a) AS a, max(stop) AS stop FROM windows GROUP BY ALL),
units AS (
  SELECT id, section_index, p, q, 0 AS w, {_strip('v')} AS unit FROM twice WHERE length(v) // 4 <= 500 AND {_strip('v')} <> ''
  UNION ALL SELECT s.id, s.section_index, s.p, s.q, n, array_to_string(e.w[a + 1:stop], ' ') FROM spans s JOIN ended e USING (id, section_index, p, q)),
listed AS (SELECT id, section_index, list(unit ORDER BY p, q, w) AS u FROM units GROUP BY id, section_index),
packed(id, section_index, i, n, tokens) AS (
  SELECT id, section_index, 1, 0, length(u[1]) // 4 FROM listed
  UNION ALL
  SELECT t.id, t.section_index, i + 1, CASE WHEN tokens + length(u[i + 1]) // 4 > 500 THEN n + 1 ELSE n END,
         CASE WHEN tokens + length(u[i + 1]) // 4 > 500 THEN length(u[i + 1]) // 4 ELSE tokens + length(u[i + 1]) // 4 END
  FROM packed t JOIN listed USING (id, section_index) WHERE i < len(u)),
chunks AS (SELECT id, section_index, n, string_agg(u[i], chr(10) || chr(10) ORDER BY i) AS chunk FROM packed JOIN listed USING (id, section_index) GROUP BY id, section_index, n)"""


def _recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


@register("chunk_documents", _recursive(f"sections AS (SELECT doc_id::VARCHAR AS id, 0 AS section_index, {_CLEAN} AS text FROM documents)", CHUNKS_SQL) + """
SELECT id AS document_id, section_index, n AS chunk_number_in_section, (row_number() OVER (PARTITION BY id ORDER BY section_index, n) - 1)::INT AS chunk_index, id AS parent_id, chunk AS text FROM chunks""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, cut into sections and chunk every document."""
    points = c.points(spark, sf_dir, vectors=False)
    cut = sections.preprocess(points.select(F.col("chunk_id").alias("document_id"), F.lit("authorial").alias("category"), F.col("text").alias("raw_text")))
    return chunking.chunk_sections(cut, F.lit("2024-01-01")).select("document_id", "section_index", "chunk_number_in_section", "chunk_index", "parent_id", "text")


@register("atomic_units", _recursive("sections AS (SELECT doc_id::VARCHAR AS id, 0 AS section_index, text FROM documents)", CHUNKS_SQL) + "SELECT id, p, q, w, unit FROM units")
def atomic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, then lines, then word windows of what is too long."""
    docs = c.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return chunking.atomic_units(docs).select("id", "p", "q", "w", "unit")


@register("chunk_collisions", _recursive(_headed_lines(), _TITLES_SQL, "sections AS (SELECT document_id AS id, section_index, text FROM titles)", CHUNKS_SQL) + """
SELECT id AS document_id, count(*) AS chunks FROM chunks GROUP BY id, n HAVING count(*) > 1""")
def chunk_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that chunks of one document share where sections have no number."""
    docs = _headed(c.table(spark, sf_dir, "documents"), _title_heading)
    cut = sections.heading_sections(docs.withColumn("category", F.lit("authorial")))
    return chunking.collision_report(chunking.chunk_sections(cut, F.lit("2024-01-01"))).drop("chunk_id")


@register("parent_ids", c.with_sql(c.POINTS_SQL) + " SELECT chunk_id, parent_id FROM points")
def parent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = c.points(spark, sf_dir, vectors=False)
    return points.select("chunk_id", text.parent_id(F.col("document_id"), F.col("section_number")).alias("parent_id"))


def uuid5_sql(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || lower(to_hex((('0x' || substr({h}, 17, 2))::INT & 63) | 128)) || substr({h}, 19, 2) || '-' || substr({h}, 21, 12))"


_NAME = "'chunk:' || parent_id || ':' || version || ':' || chunk_index"


@register("chunk_ids", c.with_sql(c.POINTS_SQL) + f" SELECT chunk_id AS id, {uuid5_sql(_NAME)} AS chunk_id FROM points")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based UUIDs of chunks."""
    points = c.points(spark, sf_dir, vectors=False)
    return points.select(F.col("chunk_id").alias("id"), text.chunk_id(F.col("parent_id"), F.col("version"), F.col("chunk_index")).alias("chunk_id"))


@register("embedding_texts", c.with_sql(c.POINTS_SQL) + " SELECT chunk_id, source_title || chr(10) || chr(10) || text AS embedding_text FROM points")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.points(spark, sf_dir, vectors=False).select("chunk_id", text.embedding_text("source_title", "text").alias("embedding_text"))


@register("parse_enrichment", """
WITH made AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'Title ' || doc_id ELSE '' END AS title,
              list_filter([source, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE ' ' END, 'q', CASE WHEN doc_id % 2 = 0 THEN 'r' ELSE '' END], lambda x: trim(x) <> '') AS q FROM documents)
SELECT doc_id, title AS synthetic_title, q AS hypothetical_questions,
       CASE WHEN title = '' THEN 'no title' WHEN len(q) NOT BETWEEN 3 AND 5 THEN 'wrong number of questions' END AS problem FROM made""")
def parse_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced JSON answers checked: blank questions dropped, three to five left, a title."""
    n = F.col("doc_id")
    title = F.when(n % 5 != 0, F.concat(F.lit("Title "), n.cast("string"))).otherwise("")
    asked = F.array("source", F.when(n % 3 != 0, F.col("lang")).otherwise(" "), F.lit("q"), F.when(n % 2 == 0, "r").otherwise(""))
    made = F.concat(F.lit("```json\n"), F.to_json(F.struct(title.alias("synthetic_title"), asked.alias("hypothetical_questions"))), F.lit("\n```"))
    rows = c.table(spark, sf_dir, "documents").select("doc_id", made.alias("answer"))
    return enrichment.parse_enrichment(rows).select("doc_id", "synthetic_title", "hypothetical_questions", "problem")


def _embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embedded chunks, and the documents that failed at either stage."""
    from ..providers import HashEmbedder, LeadEnricher

    rows = c.points(spark, sf_dir, vectors=False).select("chunk_id", "document_id", "chunk_index", "text")
    enriched, unanswered = enrichment.enrich_chunks(rows, LeadEnricher(), None)
    embedded, unplaced = enrichment.embed_chunks(enriched, HashEmbedder(c.DIMS), None)
    return embedded, unanswered.withColumn("stage", F.lit("enrich")).unionByName(unplaced.withColumn("stage", F.lit("embed")))


# A text without a word fails in enrichment; one of whose pieces no letter or digit is left fails in embedding.
_EMBEDDED_SQL = c.with_sql(c.POINTS_SQL, f"""
worded AS (SELECT chunk_id, document_id, chunk_index, text, regexp_extract_all(coalesce(text, ''), '[^{_SPACE[1:]}+') AS w FROM points),
silent AS (SELECT document_id, list(chunk_index ORDER BY chunk_index) AS failed_chunks FROM worded WHERE len(w) = 0 GROUP BY document_id),
asked AS (SELECT *, list_transform([0, 5, 10], lambda i: CASE WHEN len(w) > i THEN array_to_string(w[i + 1:i + 5], ' ') ELSE text END) AS q FROM worded WHERE document_id NOT IN (SELECT document_id FROM silent)),
blank AS (SELECT document_id, list(chunk_index ORDER BY chunk_index) AS failed_chunks FROM asked
          WHERE len(list_filter(q, lambda x: NOT regexp_matches(x, '[\\pL\\pN_]'))) > 0 OR NOT regexp_matches(text, '[\\pL\\pN_]') GROUP BY document_id)""")


@register("enrich_and_embed", _EMBEDDED_SQL + f"""
SELECT chunk_id, regexp_replace(array_to_string(w[1:8], ' '), '^[_*]+|[_*]+$', '', 'g') AS synthetic_title, 3 AS questions, {c.DIMS} AS dims, 3 AS vectors FROM asked WHERE document_id NOT IN (SELECT document_id FROM blank)""")
def enrich_and_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks enriched and embedded by the offline providers; documents with a failure are left out whole (``enrichment_failures``)."""
    embedded, _ = _embedded(spark, sf_dir)
    return embedded.select("chunk_id", "synthetic_title", F.size("hypothetical_questions").alias("questions"), F.size("chunk_vector").alias("dims"), F.size("question_vectors").alias("vectors"))


@register("enrichment_failures", _EMBEDDED_SQL + """
SELECT document_id, failed_chunks, 'no text' AS error, 'enrich' AS stage FROM silent UNION ALL SELECT document_id, failed_chunks, 'empty vector', 'embed' FROM blank""")
def enrichment_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that ``enrich_and_embed`` leaves out, with their failed chunks and the first error."""
    return _embedded(spark, sf_dir)[1]
