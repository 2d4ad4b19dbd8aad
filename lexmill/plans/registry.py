"""Named queries over the provided tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "hybrid_search"


def register(name: str, sql: str | None = None):
    """Decorator: file a (spark, sf_dir) -> DataFrame callable under ``name``."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


from . import endtoend, intake, management, preparation, retrieval  # noqa: E402, F401  they register their queries
