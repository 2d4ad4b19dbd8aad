"""Shared plumbing: the shared folder, stored tables, Arrow row mapping, size-checked broadcasts, joins on hot keys."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import fresh_path

#: Largest estimated size of a table that is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Rows of a piece that a heavy key is dealt out in, at least, and heavy keys of a table at most.
PIECE_ROWS, MOST_HEAVY = 512, 1 << 18
#: Rows and text bytes handed back to the JVM in one Arrow batch.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")

#: Folders of the tables that ``store`` wrote and nobody discarded.
_kept: set[str] = set()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until ``discard`` or ``release``: plans that read it may run later.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")  # the shuffle files of this write are not needed again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    _kept.add(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by ``store`` that no later plan reads."""
    path = getattr(df, "_lexmill_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _kept.discard(path)


def release(spark: SparkSession) -> None:
    """Delete all stored tables of this process; no frame derived from them can be read after it."""
    for path in sorted(_kept):
        _delete(spark, path)


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast where ``rows * row_bytes`` is within ``limit``; otherwise leave a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast where the rows of ``df``, as they are, take at most ``limit`` bytes; counting them runs ``df`` once."""
    fixed = sum(16 for f in df.schema if not isinstance(f.dataType, (T.StringType, T.BinaryType)))
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) + 24 for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = df.agg(F.coalesce(F.sum(sum(texts, F.lit(fixed + 16)).cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that end at ASCII white space (a longer word stays whole)."""
    at = 0
    while len(data) - at > size:
        found = _BLANK.search(data, at + size)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def heavy_keys(counts: DataFrame, key: str, rows: int, count: str = "count") -> DataFrame:
    """(key, __pieces) of the keys with very many of a table's ``rows``, from its counts by key: at most MOST_HEAVY of them."""
    most = max(PIECE_ROWS, -(-rows // MOST_HEAVY))
    return counts.where(F.col(count) > most).select(key, F.ceil(F.col(count) / most).cast("int").alias("__pieces"))


def spread_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, the keys of ``heavy`` dealt over several tasks.

    A heavy key's rows in ``left`` go to pieces by a hash of the columns ``by``, and each piece
    meets a copy of the key's rows in ``right``. Rows of ``left`` with a null key meet
    nothing and are dealt out likewise. ``how`` is inner or left.
    """
    few = F.broadcast(heavy)
    dealt = F.xxhash64(*by)
    piece = F.when(F.col(key).isNull(), F.pmod(dealt, F.lit(1 << 16))).otherwise(F.pmod(dealt, F.coalesce("__pieces", F.lit(1)))).cast("int")
    one = left.join(few, key, "left").withColumn("__piece", piece).drop("__pieces")
    copies = F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1)
    other = right.join(few, key, "left").withColumn("__piece", F.explode(copies)).drop("__pieces")
    return one.join(other, [key, "__piece"], how).drop("__piece")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` where ``fn`` takes one batch and yields batches of ``schema``, cut small on the way in."""
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for out in fn(part):
                    yield out.select(names)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system at a task's end: the worker process stays, and serves other tasks later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of at most BATCH_ROWS rows and about BATCH_BYTES bytes (a single longer row stays whole)."""
    step = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def struct(**fields: T.DataType | str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v) if isinstance(v, str) else v) for k, v in fields.items()])


def arrow_batch(schema: T.StructType, columns: dict[str, object]) -> pa.RecordBatch:
    target = to_arrow_schema(schema)
    arrays = [x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else (x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)) for f in target]
    return pa.RecordBatch.from_arrays(arrays, schema=target)
