"""Changes of the stored points, published in one version with what is derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators import index
from .sources.tables import ConcurrentChange, Snapshot, SnapshotStore

#: Times that a change begins again because another one was published first.
ATTEMPTS = 5

#: A change: of a snapshot and, by table, the rows of the buckets that it touches, to (points, other tables by name, report or None).
Change = Callable[[Snapshot, dict[str, DataFrame]], tuple[DataFrame, dict[str, DataFrame], DataFrame | None]]


def publish(store: SnapshotStore, new_points: DataFrame, keys: DataFrame, change: Change, keep: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None, stored: bool = False) -> DataFrame | None:
    """Apply ``change`` to the buckets of ``keys`` (document_id) in all tables dealt out by document; its report, stored by ``keep``.

    Where the store has a term index, the postings of the new chunks come in and those of
    the gone ones go out in the same version, and so do the kept frequencies, counted over the touched
    buckets as they are written and as they were. If another
    writer publishes meanwhile, all begins again from what is stored then. ``batch`` (name,
    number) is noted with the version, and nothing is done where it was noted before.
    ``stored``: ``new_points`` are a stored table.
    """
    tables = [t for t, spec in store.specs.items() if spec.bucket_by == "document_id"]
    for attempt in range(ATTEMPTS):
        base = store.begin()
        if batch and base.applied.get(batch[0], -1) >= batch[1]:
            return None
        touched = base.touched(keys, *tables)
        after, others, report = change(base, {t: base.read(t, touched[t]) for t in tables})
        try:
            written = {"points": base.written("points", after, touched["points"])}
            added = {}
            if "postings" in store.specs:
                terms = base.read("postings", touched["postings"])
                fresh, _, _ = index.refreshed(terms, written["points"].read(), new_points, base.read("points", touched["points"]) if stored else None)
                written["postings"] = base.written("postings", fresh, touched["postings"])
                if "frequencies" in store.specs:
                    added["frequencies"] = index.frequencies(written["postings"].read(), terms)
            told = None if report is None else keep(report)
            base.commit(written | {name: (rows, touched[name]) for name, rows in others.items()}, dict([batch]) if batch else None, added)
            return told
        except ConcurrentChange:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError("unreachable")
