"""Sections into chunks of bounded estimated size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN, chunk_id, estimated_tokens, parent_id, strip
from ..schemas import MAX_CHUNKS

# Target size and overlap in estimated tokens.
TARGET, OVERLAP = 500, 100


def word_windows(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Windows of whole words: each as long as the target allows, starting within the last one's overlap.

    A window that brings less new text than a third of the target joins the one before it.
    """
    words = text.split()
    if not words:
        return []
    ends = [0]  # ends[i]: characters of the first i words with a space after each
    for w in words:
        ends.append(ends[-1] + len(w) + 1)
    fits = target * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1
    least_new = target // 3 * CHARS_PER_TOKEN
    spans: list[list[int]] = []
    start = 0
    while True:
        stop = start + 1
        while stop < len(words) and ends[stop + 1] - ends[start] <= fits:
            stop += 1
        if spans and ends[stop] - ends[spans[-1][1]] < least_new:
            spans[-1][1] = stop
        else:
            spans.append([start, stop])
        if stop == len(words):
            return [" ".join(words[a:b]) for a, b in spans]
        back = stop
        while back > start and ends[stop] - ends[back] < overlap * CHARS_PER_TOKEN:
            back -= 1
        start = back if back > start else stop


def _windows(target: int, overlap: int):
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else word_windows(t, target, overlap))

    return run


def split_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n+"), strip), lambda x: x != "")


def split_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def _cut(text: Column, target: int) -> Column:
    """Paragraphs of a text that is too long; lines where there is one paragraph; else the text itself."""
    paragraphs, lines = split_paragraphs(text), split_lines(text)
    return F.when(estimated_tokens(text) <= target, F.array(text)).when(F.size(paragraphs) > 1, paragraphs).when(F.size(lines) > 1, lines).otherwise(F.array(text))


def atomic_units(sections: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """``sections`` with (p, q, w, unit): paragraphs, then lines, then word windows, only of what is too long.

    Cutting at paragraphs leaves no paragraph break and cutting at lines no line, so
    two cuts and the word windows are the whole recursion.
    """
    once = sections.select("*", F.posexplode(_cut(F.col("text"), target)).alias("p", "__u"))
    twice = once.select("*", F.posexplode(_cut(F.col("__u"), target)).alias("q", "__v")).drop("__u")
    long = F.when(estimated_tokens("__v") > target, F.col("__v"))  # null where there is nothing to cut
    cut = twice.withColumn("__w", _windows(target, overlap)(long))
    units = F.coalesce("__w", F.filter(F.array(strip("__v")), lambda x: x != ""))
    return cut.select(*twice.columns, F.posexplode(units).alias("w", "unit")).drop("__v")


def pack(units: Column, target: int = TARGET) -> Column:
    """Neighbouring units into chunks of at most ``target`` estimated tokens, a blank line between units."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"), F.lit(0).alias("units"))

    def add(acc: Column, unit: Column) -> Column:
        size = estimated_tokens(unit)
        full = (acc.units > 0) & (acc["size"] + size > target)
        joined = F.when(full | (acc.units == 0), unit).otherwise(F.concat(acc.open, F.lit("\n\n"), unit))
        return F.struct(
            F.when(full, F.concat(acc.done, F.array(acc.open))).otherwise(acc.done).alias("done"),
            joined.alias("open"),
            F.when(full, size).otherwise(acc["size"] + size).alias("size"),
            F.when(full, 1).otherwise(acc.units + 1).alias("units"),
        )

    return F.aggregate(units, start, add, lambda acc: F.when(acc.units > 0, F.concat(acc.done, F.array(acc.open))).otherwise(acc.done))


def chunk_sections(sections: DataFrame, version: Column | str = "version", target: int = TARGET, overlap: int = OVERLAP, id_mode: str = "reference") -> DataFrame:
    """Chunks of every section, numbered per document and per section, with deterministic ids.

    With ``id_mode='reference'`` sections without a number, and repeated numbers, share
    their document's ids, and an upsert keeps the last; 'unique' makes the section's
    index part of such ids. Empty sections give no chunks.
    """
    if id_mode not in ("reference", "unique"):
        raise ValueError(f"unknown id_mode {id_mode!r}")
    version = F.col(version) if isinstance(version, str) else version
    base = sections.withColumn("__version", version)
    keys = [c for c in base.columns if c != "text"]
    units = atomic_units(base, target, overlap)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "q", "w", "unit"))), lambda x: x.unit)
    packed = units.groupBy(*keys).agg(pack(ordered, target).alias("__chunks"))
    flat = packed.select(*keys, F.posexplode("__chunks").alias("chunk_number_in_section", "text"))
    parent = parent_id(F.col("document_id"), F.col("section_number"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("section_index", "chunk_number_in_section")) - 1
    flat = flat.withColumns({"parent_id": parent, "chunk_index": number})
    name = F.col("parent_id")
    if id_mode == "unique":
        several = F.size(F.collect_set("section_index").over(Window.partitionBy("document_id", "parent_id"))) > 1
        name = F.when(several, F.concat_ws("#", "parent_id", F.col("section_index").cast("string"))).otherwise(F.col("parent_id"))
    return flat.withColumn("chunk_id", chunk_id(name, F.col("__version"), F.col("chunk_number_in_section"))).drop("__version")


def collision_report(chunks: DataFrame) -> DataFrame:
    """Chunk ids that several chunks bear."""
    return chunks.groupBy("document_id", "chunk_id").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1")


def oversized_documents(chunks: DataFrame, most: int = MAX_CHUNKS) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks")).where(F.col("chunks") > most)


