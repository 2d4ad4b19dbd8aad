"""Versions of documents and sections as pure transformations of the stored tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parent_id
from . import filters


#: Keys that are sent to all tasks; more are met by a shuffle.
FEW_KEYS = 100_000
Met = Callable[[DataFrame, DataFrame, "str | list[str]", str], DataFrame]


def is_few(keys: DataFrame) -> bool:
    return keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS


def met_with(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """``rows.join(keys, on, how)``; few keys, as they are counted first, are sent to the tasks, so that wide rows aren't shuffled for them."""
    return rows.join(F.broadcast(keys) if is_few(keys) else keys, on, how)


def without(rows: DataFrame, every: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Stored ``rows`` of which no key is in ``gone``, where ``every`` has all their keys.

    Whichever are few, the keys that go or those that stay, are sent to the tasks.
    """
    if is_few(gone):
        return rows.join(F.broadcast(gone), key, "left_anti")
    left = every.join(gone, key, "left_anti")
    return rows.join(F.broadcast(left), key, "left_semi") if is_few(left) else rows.join(gone, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, *keys: str, order: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; of new rows with one key the last by ``order``.

    Columns in ``keep`` retain the old row's value. The old table is only anti-joined, so
    unchanged rows are not sorted.
    """
    if order is not None:
        window = Window.partitionBy(*keys).orderBy(order.desc())
        new = new.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")
    incoming = new
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        incoming = new.join(before, list(keys), "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep}).drop(*[f"__{c}" for c in keep])
    rest = old.join(new.select(*keys), list(keys), "left_anti")
    return rest.select(*old.columns).unionByName(incoming.select(*old.columns))


def keep_newest(rows: DataFrame, *keys: str, by: str) -> DataFrame:
    """Of rows with equal keys the one with the largest ``by``."""
    window = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def versions(points: DataFrame) -> DataFrame:
    """(document_id, versions ascending)."""
    return points.groupBy("document_id").agg(F.sort_array(F.collect_set("version")).alias("versions"))


def delete_document(rows: DataFrame, document_id: str, version: str | None = None) -> DataFrame:
    """What is left without a document, or without one of its versions; deleting again changes nothing."""
    return rows.where(~F.coalesce(filters.document(F.lit(document_id), None if version is None else F.lit(version)), F.lit(False)))


def delete_matching(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return rows.join(gone.select(*keys), list(keys), "left_anti")


def mark_inactive(registry: DataFrame, replaced: DataFrame) -> DataFrame:
    """Registry rows of the (document_id, version) pairs in ``replaced`` become inactive."""
    marks = replaced.select("document_id", "version").distinct().withColumn("__gone", F.lit(True))
    joined = registry.join(marks, ["document_id", "version"], "left")
    return joined.withColumn("is_active", F.col("is_active") & F.col("__gone").isNull()).select(*registry.columns)


def _updates(updates: DataFrame) -> DataFrame:
    """(parent_id, __u): a section's updates in order of date and version, each version once with its last date."""
    once = updates.groupBy("parent_id", "version").agg(F.max("effective_date").alias("effective_date"))
    return once.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("effective_date", "version"))).alias("__u"))


def supersede_sections(points: DataFrame, updates: DataFrame) -> DataFrame:
    """Flag what section updates (parent_id, version, effective_date) replace.

    Actual chunks of the parent in other versions stop being actual, until the update's
    date. Several updates of a section count in order of date and then version, as if
    one came after the other: a chunk ends with the first update of another version.
    """
    joined = points.join(_updates(updates), "parent_id", "left")
    first = F.get(F.filter("__u", lambda u: u["version"] != F.col("version")), F.lit(0))
    hit = F.coalesce(F.col("is_actual"), F.lit(False)) & first.isNotNull()
    return joined.withColumns({
        "effective_until": F.when(hit, first["effective_date"]).otherwise(F.col("effective_until")),
        "is_actual": F.when(hit, F.lit(False)).otherwise(F.col("is_actual")),
    }).select(*points.columns)


def ingest_documents(points: DataFrame, registry: DataFrame, new_points: DataFrame, new_rows: DataFrame, purge_same_version: bool = False, order: Column | None = None, settled: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, registry, report) after whole documents are ingested.

    New chunks are put in by id; every other version of their documents is deleted,
    and made inactive in the registry. Of several versions of a document in ``new_rows``
    the last by ``order`` (by version, if not given) is kept, as if they came one after the
    other: the earlier ones are inactive rows of the registry without chunks, and
    reported as replaced. Chunks of the same version that the new text no longer has stay,
    unless ``purge_same_version``. ``settled``: all tables are stored, no chunk id comes twice
    in either of the points, and the new ones hold of each document that last version alone; then only keys are
    shuffled, and no points.
    """
    by = [F.col("version").desc()] if order is None else [order.desc(), F.col("version").desc()]
    first = Window.partitionBy("document_id").orderBy(*by)
    placed = new_rows.withColumn("__last", F.first_value("version").over(first)).withColumn("__n", F.row_number().over(Window.partitionBy("document_id", "version").orderBy(*by)))
    placed = placed.where("__n = 1").drop("__n")
    won = F.col("version") == F.col("__last")
    arrived = placed.where(won).select("document_id", F.col("version").alias("__new"))

    stale = (F.col("version") != F.col("__new")) | F.lit(purge_same_version)
    if settled:
        mine, ids = new_points, points.select("chunk_id")
        gone = points.select("chunk_id", "document_id", "version").join(arrived, "document_id").where(stale).select("chunk_id")
        gone = gone.unionByName(ids.join(mine.select("chunk_id"), "chunk_id", "left_semi")).distinct()
        after = without(points, ids, gone, "chunk_id").select(*points.columns).unionByName(mine.select(*points.columns))
    else:
        current = points.join(arrived, "document_id", "left")
        kept = current.where(F.col("__new").isNull() | ~stale).select(*points.columns)
        mine = new_points.join(arrived.select("document_id", F.col("__new").alias("version")), ["document_id", "version"], "left_semi")
        after = upsert(kept, mine, "chunk_id", order=F.col("chunk_index"))

    incoming = placed.withColumn("is_active", F.col("is_active") & won).drop("__last")
    listed = upsert(registry, incoming, "document_id", "version", keep=("created_at",)).join(arrived, "document_id", "left")
    in_force = F.col("__new").isNull() | (F.col("version") == F.col("__new"))
    rows = listed.withColumn("is_active", F.col("is_active") & in_force).select(*registry.columns)

    replaced = points.select("document_id", "version").join(arrived, "document_id").where("version <> __new").select("document_id", "version")
    replaced = replaced.unionByName(placed.where(~won).select("document_id", "version"))
    counts = mine.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks_count"))
    dropped = replaced.groupBy("document_id").agg(F.sort_array(F.collect_set("version")).alias("replaced_versions"))
    report = arrived.withColumnRenamed("__new", "version").join(counts, "document_id", "left").join(dropped, "document_id", "left")
    return after, rows, report.withColumns({"chunks_count": F.coalesce("chunks_count", F.lit(0)), "replaced_versions": F.coalesce("replaced_versions", F.array().cast("array<string>"))})


def ingest_sections(points: DataFrame, new_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, report) after single sections are replaced; history stays, the registry is not touched.

    Of several updates of a section the last is actual, the earlier ones are history that
    ends with the update after them.
    """
    updates = new_points.select("parent_id", "version", "effective_date")
    listed = _updates(updates)
    own = F.element_at(F.filter("__u", lambda u: u["version"] == F.col("version")), 1)
    after_it = F.get(F.filter("__u", lambda u: u > F.col("__own")), F.lit(0))
    dated = new_points.join(listed, "parent_id").withColumn("__own", own).withColumn("__next", after_it)
    dated = dated.withColumns({
        "effective_until": F.when(F.col("__next").isNotNull(), F.col("__next.effective_date")).otherwise(F.col("effective_until")),
        "is_actual": F.col("is_actual") & F.col("__next").isNull(),
    }).select(*new_points.columns)
    old = points.where("is_actual").join(listed, "parent_id").where(F.exists("__u", lambda u: u["version"] != F.col("version")))
    report = old.groupBy("parent_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("replaced_ids"))
    return upsert(supersede_sections(points, updates), dated, "chunk_id", order=F.col("chunk_index")), report


def actual_chunk_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("document_id", "version").agg(F.count_if("is_actual").alias("actual_chunks"))


def list_chunks(points: DataFrame, document_id: str | None = None, version: str | None = None) -> DataFrame:
    """Chunks with their history, in order of chunk_index (missing counts as 0)."""
    found = points if document_id is None else points.where(filters.document(F.lit(document_id), None if version is None else F.lit(version)))
    return found.orderBy("document_id", F.coalesce("chunk_index", F.lit(0)), "chunk_id")


def as_points(chunks: DataFrame, meta: DataFrame, as_of: Column) -> DataFrame:
    """Chunks with their document's metadata: added on ``as_of``, actual, in force without end."""
    known = meta.select("document_id", "source_title", "audience", "topics", "version", "effective_date")
    joined = chunks.drop("version").join(known, "document_id")
    return joined.withColumns({"parent_id": parent_id(F.col("document_id"), F.col("section_number")), "date_added": as_of, "effective_until": F.lit(None).cast("date"), "is_actual": F.lit(True)})


def as_of(points: DataFrame, day: Column) -> DataFrame:
    """The revision in force on a day."""
    return points.where((F.col("effective_date") <= day) & (F.col("effective_until").isNull() | (day < F.col("effective_until"))))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
