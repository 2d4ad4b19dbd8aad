"""Metadata predicates: fixed values, or columns of a queries table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import SECTION_UPDATE_CATEGORIES, TOP_K_MOST, TOPIC_CATEGORIES


def actual() -> Column:
    return F.col("is_actual")


def audience(value: Column) -> Column:
    """No value: every audience. A value: that audience and what is meant for both."""
    return value.isNull() | (F.col("audience") == value) | (F.col("audience") == "both")


def topic(value: Column) -> Column:
    return value.isNull() | F.array_contains("topics", value)


def category(value: Column) -> Column:
    return value.isNull() | (F.col("category") == value)


def document(document_id: Column, version: Column | None = None) -> Column:
    same = F.col("document_id") == document_id
    return same if version is None else same & (F.col("version") == version)


def replaced_section(parent: Column, version: Column) -> Column:
    """Actual chunks of a parent in versions other than ``version``."""
    return (F.col("parent_id") == parent) & F.col("is_actual") & (F.col("version") != version)


def recent(column: str, as_of: Column, hours: int = 24) -> Column:
    return F.col(column) >= as_of - F.make_dt_interval(hours=F.lit(hours))


def request_problem() -> Column:
    """Why a search request is refused, or null."""
    return (
        F.when(strip(F.coalesce("query", F.lit(""))) == "", "empty query")
        .when(~F.coalesce(F.col("top_k").between(1, TOP_K_MOST), F.lit(True)), "top_k out of range")
    )


def document_problem(section_update: bool = False) -> Column:
    """Why a document (or a section update) is refused by its category, or null."""
    topics = (F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0) & ~F.col("category").isin(*TOPIC_CATEGORIES)
    out = F.when(topics, "topics not allowed for category")
    if section_update:
        out = out.when(~F.col("category").isin(*SECTION_UPDATE_CATEGORIES), "section update not allowed for category")
    return out
