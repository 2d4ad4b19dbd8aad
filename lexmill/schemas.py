"""Canonical tables of the engine: types, enumerations, policies and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Enumerations (their order is the lane order) and policies.
CATEGORIES = ("labor_code", "case_law", "federal_law", "other_npa", "authorial")
AUDIENCES = ("seeker", "employer", "both")
LAW_CATEGORIES = ("labor_code", "federal_law")
NPA_CATEGORIES = ("other_npa", "case_law")
SECTION_UPDATE_CATEGORIES = ("labor_code", "federal_law", "other_npa")
TOPIC_CATEGORIES = ("other_npa", "case_law", "authorial")
INITIAL_TOPICS = ("квотирование", "трудовые права", "приём на работу", "увольнение", "трудоустройство", "рабочее место инвалидов", "охрана труда", "дискриминация")
MAX_RAW_CHARS, MAX_CHUNKS, MAX_FILE_BYTES, MAX_PDF_PAGES = 2_000_000, 2000, 20 * 1024 * 1024, 2000
QUESTIONS, LEAST_QUESTIONS = 5, 3
TOP_K_DEFAULT, TOP_K_MOST = 5, 20
# Characters of a candidate that a reranking model sees, and what stands around the query and between candidates.
CANDIDATE_CHARS, LEAD, BETWEEN = 2500, ("<user_query>", "</user_query>\n\nКандидаты:\n"), "\n\n"
MAX_SUB_QUESTIONS, MAX_REPHRASINGS = 3, 1


_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _fields(text: str, between: str) -> T.StructType:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(text[at:i].strip())
            at = i + 1
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in (p.split(between, 1) for p in parts)])


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("struct<"):
        return _fields(text[7:-1], ":")
    return _SIMPLE[text]


def schema(text: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session, so workers can import this module."""
    return _fields(text, " ")


POINTS = schema(
    "chunk_id string, document_id string, parent_id string, category string, source_title string, audience string,"
    " topics array<string>, date_added date, chunk_index int, chunk_number_in_section int, version string,"
    " effective_date date, effective_until date, is_actual boolean, section_number string, section_title string, text string,"
    " synthetic_title string, hypothetical_questions array<string>, chunk_vector array<float>, question_vectors array<array<float>>, chunk_code binary, chunk_scale double"
)
REGISTRY = schema(
    "document_id string, version string, category string, source_title string, audience string, topics array<string>,"
    " effective_date date, is_active boolean, created_at timestamp, updated_at timestamp"
)
_CANDIDATES = "array<struct<chunk_id:string,score:double>>"
SEARCH_LOGS = schema(
    f"request_id string, query string, query_variants array<string>, audience string, topic string, category string, dense_candidates {_CANDIDATES}, sparse_candidates {_CANDIDATES}, rrf_candidates {_CANDIDATES},"
    " reranked_chunk_ids array<string>, final_response string, query_expansion_status string, reranker_status string, latency_query_expansion_ms double, latency_embed_query_ms double,"
    " latency_hybrid_search_ms double, latency_rerank_ms double, created_at timestamp"
)


def schema_problems(df: DataFrame, expected: T.StructType) -> list[str]:
    """Every missing column and every wrong type, not just the first."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    problems = [f"column {f.name} is missing" for f in expected if f.name not in have]
    problems += [f"column {f.name} is {have[f.name]}, not {f.dataType.simpleString()}" for f in expected if f.name in have and have[f.name] != f.dataType.simpleString()]
    return problems


def validate_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    if problems := schema_problems(df, expected):
        raise ValueError("; ".join(problems))
    return df
