"""JSON bodies of ingest and section requests into typed rows, with all problems of a body at once; bodies of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import AUDIENCES, CATEGORIES, MAX_RAW_CHARS

#: Fields of the bodies: those with a least length, and those whose value is one of a list.
INGEST = ("document_id", "category", "raw_text", "source_title", "audience", "version", "effective_date")
SECTION = ("category", "raw_text", "section_title", "source_title", "audience", "version", "effective_date")
NOT_EMPTY, CHOICES = ("document_id", "raw_text", "section_title"), {"category": CATEGORIES, "audience": AUDIENCES}


def _at(name: str, kind: str) -> Column:
    return F.try_variant_get("__v", f"$.{name}", kind)


def _kind(name: str) -> Column:
    return F.schema_of_variant(_at(name, "variant"))


def _text_problem(name: str) -> Column:
    value = _at(name, "string")
    out = F.when(_kind(name).isNull(), "missing").when(_kind(name) != "STRING", "not a string")
    if name in NOT_EMPTY:
        out = out.when(value == "", "empty")
    if name == "raw_text":
        out = out.when(F.length(value) > MAX_RAW_CHARS, "too long")
    if name in CHOICES:
        out = out.when(~value.isin(*CHOICES[name]), "unknown")
    if name == "effective_date":
        out = out.when(~value.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.expr("try_cast(try_variant_get(__v, '$.effective_date', 'string') as date)").isNull(), "not a date")
    return F.when(out.isNotNull(), F.concat(F.lit(f"{name}: "), out))


def _read(bodies: DataFrame, keys: list[str], body: str, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    parsed = bodies.withColumn("__v", F.try_parse_json(body))
    whole = F.schema_of_variant("__v").startswith("OBJECT")
    topics = F.when(_kind("topics").isNotNull() & ~_kind("topics").isin("ARRAY<STRING>", "ARRAY<VOID>") | F.exists(F.coalesce(_at("topics", "array<string>"), F.array().cast("array<string>")), lambda t: t.isNull()), "topics: not a list of strings")
    found = F.filter(F.array(*[_text_problem(f) for f in fields], topics), lambda p: p.isNotNull())
    judged = parsed.withColumn("problems", F.when(F.coalesce(whole, F.lit(False)), found).otherwise(F.array(F.lit("not an object"))))
    values = {f: _at(f, "string") for f in fields} | {"effective_date": _at("effective_date", "date"), "topics": F.coalesce(_at("topics", "array<string>"), F.array().cast("array<string>"))}
    good = judged.where("size(problems) = 0").select(*keys, *[v.alias(k) for k, v in values.items()])
    return good, judged.where("size(problems) > 0").select(*keys, "problems")


def read_ingests(bodies: DataFrame, key: str = "request_id", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(documents, refusals) of bodies (key, body): rows as ``service.ingest`` takes them, with the key; (key, problems).

    A body must be an object. Every field but topics is required and a string; problems are
    ``field: missing``, ``not a string``, ``empty``, ``too long``, ``unknown`` or ``not a date``, in the
    order of fields. Other fields are ignored.
    """
    return _read(bodies, [key], body, INGEST)


def read_section_updates(bodies: DataFrame, key: str = "request_id", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """The same for section updates (key, document_id, section_number, body), rows as ``service.update_sections`` takes them."""
    return _read(bodies, [key, "document_id", "section_number"], body, SECTION)


def ingest_responses(report: DataFrame) -> DataFrame:
    """(document_id, response) of what an ingest did: all replaced versions go with it, so none is left to remove."""
    left = F.array().cast("array<string>").alias("not_removed_versions")
    return report.select("document_id", F.to_json(F.struct("document_id", "version", "chunks_count", "replaced_versions", left)).alias("response"))


def section_responses(report: DataFrame) -> DataFrame:
    fields = ("document_id", "section_number", "parent_id", "version", "chunks_count", "superseded_chunks")
    return report.select("document_id", "section_number", F.to_json(F.struct(*fields)).alias("response"))
