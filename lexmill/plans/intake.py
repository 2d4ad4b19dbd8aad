"""Named queries: uploaded files, and the search log as it is appended and read."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import service
from ..schemas import schema
from ..session import fresh_path
from ..sources import uploads
from ..sources.tables import LogTable
from . import corpus as c
from .registry import register

_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _document(words: list[str]) -> bytes:
    """A word-processor file: a paragraph a word, each with a raised 7 after a digit, then a table of the first two words."""
    raised = "<w:r><w:rPr><w:vertAlign w:val='superscript'/></w:rPr><w:t>7</w:t></w:r>"
    paragraphs = "".join(f"<w:p><w:r><w:t>{escape(w)} 5</w:t></w:r>{raised}</w:p>" for w in words)
    cells = "".join(f"<w:tc><w:p><w:r><w:t>{escape(w)}</w:t></w:r></w:p></w:tc>" for w in words[:2])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{_NS}'><w:body>{paragraphs}<w:tbl><w:tr>{cells}</w:tr></w:tbl></w:body></w:document>")
    return out.getvalue()


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a file: text, Markdown, a document, or one of three kinds that are refused."""

    def make(batches):
        for rows in batches:
            out = []
            for i, text in zip(rows["item_id"], rows["text"]):
                kind = ("txt", "md", "docx", "exe", "bad.docx", "latin.txt")[i % 6]
                content = _document(text.split()[:9]) if kind == "docx" else b"no archive" if kind == "bad.docx" else b"\xff\xfe" if kind == "latin.txt" else text.encode()
                out.append((f"item{i}.{kind.upper() if i % 12 > 5 else kind}", content))
            yield pd.DataFrame(out, columns=["path", "content"])

    return c.table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(make, "path string, content binary")


_NAME = "'item' || item_id || '.' || CASE WHEN item_id % 12 > 5 THEN upper(kind) ELSE kind END"
_KINDS = "kinds AS (SELECT *, (['txt', 'md', 'docx', 'exe', 'bad.docx', 'latin.txt'])[item_id % 6 + 1] AS kind, regexp_extract_all(text, '\\S+')[1:9] AS w FROM benchmark)"


@register("uploaded_texts", f"""
WITH {_KINDS} SELECT {_NAME} AS path, text FROM kinds WHERE kind IN ('txt', 'md')
UNION ALL SELECT {_NAME}, array_to_string(list_transform(w, lambda x: x || ' 5.7') || w[1:2], chr(10)) FROM kinds WHERE kind = 'docx'""")
def uploaded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of uploaded files: plain text, Markdown, documents with raised numbers and tables."""
    return uploads.extract(_files(spark, sf_dir))[0]


@register("refused_uploads", f"WITH {_KINDS} SELECT {_NAME} AS path, kind = 'exe' AS unsupported FROM kinds WHERE kind NOT IN ('txt', 'md', 'docx')")
def refused_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of unknown kinds, broken ones and texts that aren't UTF-8."""
    return uploads.extract(_files(spark, sf_dir))[1].select("path", F.col("reason").startswith("unsupported").alias("unsupported"))


_LOG = schema("request_id string, query string, created_at timestamp")


@register("appended_logs", """
SELECT event_id::VARCHAR AS request_id, event_type AS query FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'""")
def appended_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log appended in two parts and read from a time on."""
    rows = c.search_logs(spark, sf_dir).select("request_id", "query", "created_at")
    log = LogTable(spark, fresh_path(spark, "log"), _LOG)
    odd = F.crc32("request_id") % 2 == 1
    log.append(rows.where(odd))
    log.append(rows.where(~odd))
    return log.read("2024-01-20 12:00:00").select("request_id", "query")


def _logged_sql() -> str:
    from . import endtoend as e

    laned = "(SELECT count(*) FROM lanes WHERE query_id // 2 = item_id AND ordinal {})"
    return c.with_sql(*e._PARTS).replace("WITH", "WITH RECURSIVE", 1) + f"""
SELECT 'r' || item_id AS request_id, [w.text, substr(w.text, 1, length(w.text) // 2)] AS query_variants, {laned.format('< 5')} AS dense, {laned.format('= 5')} AS sparse,
       coalesce((SELECT list(chunk_id ORDER BY rank) FROM shown WHERE q = item_id), []) AS fused, coalesce((SELECT list(chunk_id ORDER BY position) FROM told WHERE q = item_id AND position <= 4), []) AS reranked, true AS whole
FROM wanted w"""


@register("logged_searches", _logged_sql())
def logged_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches written to the log and read again: variants, candidates of each kind before and after fusion, the reranked chunks; failed ones have no row."""
    from ..schemas import SEARCH_LOGS
    from .endtoend import answers, asked

    rows = service.log_rows(answers(spark, sf_dir), asked(spark, sf_dir).withColumn("request_id", F.concat(F.lit("r"), "query_id")), F.lit("2024-03-05 00:00:00").cast("timestamp"))
    log = LogTable(spark, fresh_path(spark, "search-log"), SEARCH_LOGS)
    log.append(rows)
    given = F.from_json("final_response", "chunks array<struct<chunk_id: string>>")
    whole = (given["chunks"]["chunk_id"] == F.col("reranked_chunk_ids")) & F.col("latency_rerank_ms").isNotNull() & (F.col("latency_hybrid_search_ms") > 0)
    size = lambda x: F.size(x).cast("long")
    return log.read().select("request_id", "query_variants", size("dense_candidates").alias("dense"), size("sparse_candidates").alias("sparse"), F.col("rrf_candidates.chunk_id").alias("fused"), F.col("reranked_chunk_ids").alias("reranked"), whole.alias("whole"))
