"""Documents into sections: legal articles, numbered points, Markdown headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip
from ..schemas import LAW_CATEGORIES, NPA_CATEGORIES

# What opens a section. Group 1 is a number (or a title, for headings).
ARTICLE = r"(?mdU)^Статья\s+(\d+(?:\.\d+)?)\.?\s*(.*)$"
POINT = r"(?mdU)^(\d+)(?:\.(?!\d)|\))(\s+)"
HEADING = r"(?mdU)^#{1,3}\s+(.+)$"
TITLE_CHARS = 80

#: Marks around what a heading is replaced by: noncharacters, which no interchanged text holds; stray ones are dropped.
_OPEN, _MIDDLE, _CLOSE, _WHOLE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"

LAW, POINTS, HEADINGS = "law", "points", "headings"
_FORMS = {LAW: (ARTICLE, f"$1{_MIDDLE}$2"), POINTS: (POINT, f"$1{_MIDDLE}$0"), HEADINGS: (HEADING, "$1")}


def _pieces(text: Column, kind: Column) -> Column:
    """The text after each match of the kind's pattern, each piece led by its heading in marks.

    What precedes the first match is dropped; a text without any match is one piece, led by _WHOLE.
    """
    bare = F.translate(text, _OPEN + _MIDDLE + _CLOSE + _WHOLE, "")
    cut = lambda form: F.split(F.regexp_replace(bare, form[0], _OPEN + form[1] + _CLOSE), _OPEN)
    parts = F.when(kind == LAW, cut(_FORMS[LAW])).when(kind == POINTS, cut(_FORMS[POINTS])).otherwise(cut(_FORMS[HEADINGS]))
    # bound to a lambda's variable, so that the text is cut once
    kept = F.transform(F.array(parts), lambda p: F.when(F.size(p) > 1, F.slice(p, 2, F.size(p))).otherwise(F.transform(p, lambda x: F.concat(F.lit(_WHOLE + _CLOSE), x))))
    return F.get(kept, F.lit(0))


_OUT = ("document_id", "category", "section_index", "section_number", "section_title", "text")


def _sections(docs: DataFrame, kind: Column) -> DataFrame:
    """(document_id, category, text) cut into sections by ``kind``, in one pass over the texts.

    Pieces under a repeated article number join its first occurrence, so one aggregate by
    document and number (other kinds: and place) follows. A null text gives no section.
    """
    cut = docs.select("document_id", "category", kind.alias("__kind"), F.posexplode(_pieces(F.col("text"), kind)).alias("pos", "piece"))
    head, body = F.substring_index("piece", _CLOSE, 1), F.substring_index("piece", _CLOSE, -1)
    parts = cut.select("document_id", "category", "pos", F.when(head == _WHOLE, "whole").otherwise(F.col("__kind")).alias("kind"), head.alias("head"), body.alias("body"))
    is_law, is_point = F.col("kind") == LAW, F.col("kind") == POINTS
    first, rest = F.substring_index("head", _MIDDLE, 1), F.substring_index("head", _MIDDLE, -1)
    parts = parts.withColumns({
        "number": F.when(is_law | is_point, first),
        "body": strip(F.when(is_point, F.concat(rest, "body")).otherwise(F.col("body"))),
        "title": strip(F.when(is_law, rest).when(F.col("kind") == HEADINGS, F.col("head"))),
        "key": F.when(is_law, first).otherwise(F.col("pos").cast("string")),
    })
    several = F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("pos", "body"))))
    merged = parts.groupBy("document_id", "category", "kind", "number", "key").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"), F.array_join(F.transform(several, lambda x: x.body), "\n").alias("text"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("pos")) - 1
    title = (
        F.when(is_law, F.concat(F.lit("Статья "), "number", F.when(F.col("title") != "", F.concat(F.lit(". "), "title")).otherwise("")))
        .when(is_point, F.substring(strip(F.substring_index("text", "\n", 1)), 1, TITLE_CHARS))
        .when(F.col("kind") == "whole", F.col("document_id")).otherwise(F.col("title"))
    )
    return merged.select("document_id", "category", place.alias("section_index"), F.col("number").alias("section_number"), title.alias("section_title"), "text").select(*_OUT)


def law_sections(docs: DataFrame) -> DataFrame:
    """One section per article number; text under a repeated number joins its first occurrence."""
    return _sections(docs, F.lit(LAW))


def point_sections(docs: DataFrame) -> DataFrame:
    """One section per top-level numbered point; the heading stays in the text, its first line is the title."""
    return _sections(docs, F.lit(POINTS))


def heading_sections(docs: DataFrame) -> DataFrame:
    """One section per Markdown heading of levels 1 to 3, without a number."""
    return _sections(docs, F.lit(HEADINGS))


def preprocess(docs: DataFrame) -> DataFrame:
    """(document_id, category, raw_text) cleaned and cut into sections by the category's structure; document ids are unique."""
    kind = F.when(F.col("category").isin(*LAW_CATEGORIES), LAW).when(F.col("category").isin(*NPA_CATEGORIES), POINTS).otherwise(HEADINGS)
    return _sections(docs.select("document_id", "category", clean_text("raw_text").alias("text")), kind)


def section_report(sections: DataFrame) -> DataFrame:
    """Per document: sections, dotted numbers, suspicious ones (over three digits without a dot), repeated numbers."""
    number = F.col("section_number")
    per_number = sections.groupBy("document_id", "section_number").count()
    dotted, plain = number.contains("."), ~number.contains(".") & (F.length(number) > 3)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    return per_number.groupBy("document_id").agg(F.sum("count").alias("sections"), total(dotted).alias("dotted"), total(plain).alias("suspicious"), F.count_if(F.col("count") > 1).alias("repeated"))
