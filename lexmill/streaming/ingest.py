"""Continuous ingest: batches of documents from a stream applied to the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.lifecycle import ingest_documents
from ..publishing import publish
from ..sources.tables import SnapshotStore


def ingest_stream(documents: DataFrame, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], store: SnapshotStore, checkpoint: str, name: str = "ingest", order: Column | None = None) -> DataStreamWriter:
    """Apply each micro-batch as one whole-document ingest into the tables points and registry.

    ``build`` turns a batch of documents into (points, registry rows). A batch reads and
    writes only the buckets of its documents, and changes points, registry, postings and
    kept frequencies (where the store has them) in one version of the store, which notes the
    batch: one that is replayed after a failure is skipped if that version was published,
    else applied whole. Of several versions of a document in a batch the last by ``order`` counts.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        points, rows = build(batch)
        keys = points.select("document_id").union(rows.select("document_id"))

        def change(_, stored):
            after, registry, _report = ingest_documents(stored["points"], stored["registry"], points, rows, order=order)
            return after, {"registry": registry}, None

        publish(store, points, keys, change, lambda df: df, (name, number))

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
