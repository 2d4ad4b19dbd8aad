"""Stored tables: versioned snapshots of which only changed buckets are written anew, and append-only logs."""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import schema_problems, validate_schema

#: Buckets of a table at first (a power of two), and bytes above which one is split.
BUCKETS, BUCKET_BYTES = 64, 256 << 20
#: Added parts of a table are merged into it when they are so many, or take this share of its bytes.
MOST_ADDED, ADDED_SHARE = 16, 0.25
#: Keys that are looked up in the files themselves; more are joined.
PUSHED_KEYS = 1_000


class ConcurrentChange(RuntimeError):
    """Another writer has published a version since this one began; nothing was changed."""


@dataclass(frozen=True)
class TableSpec:
    """A table's columns, the column whose hash deals its rows out to buckets, and the order of rows within a file.

    ``bucket_by`` None: the table is one bucket, written where its rows are made, without a shuffle, and only
    replaced as a whole. ``bloom``: columns whose values are looked up; files have Bloom filters of them. ``sums``: a
    column of which rows with equal keys count as their sum, so that a change may be
    added to the table without rewriting any of it.
    """

    schema: T.StructType
    bucket_by: str | None
    sort_by: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()
    sums: str | None = None


def _bucket(depth: int, value: int) -> str:
    return f"{depth}-{value}"


def _children(bucket: str, levels: int) -> set[str]:
    """The buckets that are split where ``bucket`` is, ``levels`` times: itself and those below it but the last."""
    depth, value = map(int, bucket.split("-"))
    return {_bucket(depth + k, value + (i << depth)) for k in range(levels) for i in range(1 << k)}


@dataclass(frozen=True)
class Written:
    """New rows of a table in folders that no version names yet, and the buckets that they replace (None: all)."""

    store: SnapshotStore
    table: str
    parts: dict[str, dict]
    splits: set[str]
    buckets: Iterable[str] | None

    def read(self) -> DataFrame:
        return self.store.rows_of(self.table, [self.parts[b]["path"] for b in sorted(self.parts)])


@dataclass
class Snapshot:
    """One version of a store: what its readers see, and the base of the next version.

    A bucket ``d-v`` holds the rows whose key's hash ends in the ``d`` bits of ``v``; ``splits``
    has the buckets that were split in two by one more bit.
    """

    store: SnapshotStore
    number: int
    parts: dict[str, dict[str, dict]] = field(default_factory=dict)
    added: dict[str, list[dict]] = field(default_factory=dict)
    splits: dict[str, list[str]] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)

    def read(self, table: str, buckets: Iterable[str] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets."""
        spec, store = self.store.specs[table], self.store
        known = self.parts.get(table, {})
        wanted = known if buckets is None else set(buckets) & known.keys()
        rows = store.rows_of(table, [known[b]["path"] for b in sorted(wanted)])
        if buckets is None and (added := self.added.get(table)):
            both = rows.unionByName(store.rows_of(table, [p["path"] for p in added]))
            keys = [f for f in spec.schema.fieldNames() if f != spec.sums]
            rows = both.groupBy(*keys).agg(F.sum(spec.sums).alias(spec.sums)).where(F.col(spec.sums) != 0).select(*spec.schema.fieldNames())
        return rows

    def bucket_of(self, table: str, hashed: int) -> str:
        splits, depth = set(self.splits.get(table, ())), self.store.depth
        while (at := _bucket(depth, hashed % (1 << depth))) in splits:
            depth += 1
        return at

    def touched(self, rows: DataFrame, *tables: str) -> dict[str, list[str]]:
        """Per table the buckets of the rows' keys; the tables are dealt out by the same column."""
        (key,) = {self.store.specs[t].bucket_by for t in tables}
        deepest = max([self.store.depth, *(int(b.split("-")[0]) + 1 for t in tables for b in self.splits.get(t, ()))])
        found = [r[0] for r in rows.select(F.pmod(F.xxhash64(key), F.lit(1 << deepest)).alias("h")).distinct().collect()]
        return {t: sorted({self.bucket_of(t, h) for h in found}) for t in tables}

    def lookup(self, table: str, keys: DataFrame, column: str) -> DataFrame:
        """The rows whose ``column`` is among those of ``keys``.

        By the column that deals the table out only the buckets of the keys are opened. Few keys are
        looked up in the files, which skip what their Bloom filters and ranges exclude; more are joined.
        """
        known = keys.select(column).distinct()
        some = [r[0] for r in known.limit(PUSHED_KEYS + 1).collect()]
        buckets = self.touched(known, table)[table] if column == self.store.specs[table].bucket_by else None
        rows = self.read(table, buckets)
        return rows.where(F.col(column).isin(some)) if len(some) <= PUSHED_KEYS else rows.join(known, column, "left_semi")

    def written(self, table: str, rows: DataFrame, buckets: Iterable[str] | None) -> Written:
        """The rows written for ``commit``, so that other tables can be derived from them before."""
        store = self.store
        if self.number < 0:  # data without a version is then always an error
            self.number = store.publish(Snapshot(store, 0)).number
        parts, splits = store.write(table, rows, set(self.splits.get(table, ())), None if buckets is None else set(buckets))
        return Written(store, table, parts, splits, buckets)

    def commit(self, changes: dict[str, tuple[DataFrame, Iterable[str] | None] | Written], applied: dict[str, int] | None = None, added: dict[str, DataFrame] | None = None) -> Snapshot:
        """Publish the next version of all tables at once.

        ``changes`` has per table its new rows and the buckets that they replace (None: all), or what was ``written`` of them;
        other buckets stay as they are. ``added`` has rows to add to tables with sums. The
        rows may be derived from this snapshot. ``applied`` notes the last batch of each
        stream, for replays. A failure before the version is published changes nothing;
        ConcurrentChange if another version was.
        """
        store = self.store
        if self.number < 0:  # data without a version is then always an error
            self.number = store.publish(Snapshot(store, 0)).number
        parts = {name: dict(self.parts.get(name, {})) for name in store.specs}
        more = {name: list(self.added.get(name, [])) for name in store.specs}
        splits = {name: set(self.splits.get(name, ())) for name in store.specs}
        for table, given in changes.items():
            made = given if isinstance(given, Written) else self.written(table, *given)
            old, splits[table] = set(parts[table] if made.buckets is None else made.buckets), made.splits
            if made.buckets is None:
                more[table] = []
            parts[table] = {b: p for b, p in parts[table].items() if b not in old} | made.parts
        for table, rows in (added or {}).items():
            part = store.write_added(table, rows)
            more[table] = [*more[table], *([part] if part else [])]
            size, base = sum(p["bytes"] for p in more[table]), sum(p["bytes"] for p in parts[table].values())
            if len(more[table]) > MOST_ADDED or size > ADDED_SHARE * base:
                merged = Snapshot(store, self.number, parts, more, {}).read(table)
                parts[table], splits[table] = store.write(table, merged, splits[table], None)
                more[table] = []
        return store.publish(Snapshot(store, self.number + 1, parts, more, {k: sorted(v) for k, v in splits.items()}, self.applied | (applied or {})))


class SnapshotStore:
    """Parquet tables that change together, by versions.

    A version is a numbered pointer file that names the folder of every bucket of every
    table. It is written whole under another name and then given its number, which must
    be free: readers take the highest, there is never a moment without a current
    version, a crash anywhere leaves the version before, and of writers that began
    at the same version one alone succeeds. (The store's file system must rename without
    overwriting, as HDFS and local ones do.) A change writes only the buckets that it touches,
    and a bucket that is written with over ``bucket_bytes`` is split by further bits
    of the hash, so that a change writes about as much whatever the store holds. Folders that
    neither the current version nor the one before it names are deleted when a version
    is published, and only such as an earlier version named: a write that another
    writer has begun is left alone.
    """

    def __init__(self, spark: SparkSession, path: str, specs: dict[str, TableSpec], buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.path, self.specs, self.bucket_bytes = spark, path.rstrip("/"), specs, bucket_bytes
        self.depth = max(0, buckets - 1).bit_length()
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _get(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> bool:
        """Create a whole file under a name that must be free; whether it was."""
        spare = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        if self._fs.getScheme() == "file":  # where a rename would overwrite
            at = lambda n: urlparse(self._path(n).toUri().toString()).path
            os.makedirs(os.path.dirname(at(name)), exist_ok=True)
            with open(at(spare), "w") as out:
                out.write(text)
            try:
                os.link(at(spare), at(name))
            except FileExistsError:
                return False
            finally:
                os.unlink(at(spare))
            return True
        stream = self._fs.create(self._path(spare), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        kept = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(spare), self._path(name), kept)
        except Py4JJavaError as e:
            self._fs.delete(self._path(spare), False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("_versions") if n.isdigit())

    def _load(self, number: int) -> Snapshot:
        found = json.loads(self._get(f"_versions/{number:012d}"))
        return Snapshot(self, number, found["parts"], found["added"], found["splits"], found["applied"])

    def begin(self) -> Snapshot:
        """The current version; a folder that was never written is an empty store."""
        if numbers := self._numbers():
            return self._load(numbers[-1])
        if self._names("data"):
            raise OSError(f"{self.path} has data but no version")
        return Snapshot(self, -1)

    def rows_of(self, table: str, paths: list[str]) -> DataFrame:
        spec = self.specs[table]
        if not paths:  # known to be empty where plans are made
            return self.spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spec.schema.fields])
        return self.spark.read.schema(spec.schema).parquet(*[f"{self.path}/{p}" for p in paths]).select(*spec.schema.fieldNames())

    def problems(self) -> list[str]:
        """What of the stored files does not fit the tables' schemas, all at once."""
        now, out = self.begin(), []
        for table, spec in self.specs.items():
            for path in sorted({p["path"] for p in (*now.parts.get(table, {}).values(), *now.added.get(table, []))}):
                out += [f"{table}, {path}: {p}" for p in schema_problems(self.spark.read.parquet(f"{self.path}/{path}"), spec.schema)]
        return out

    def bucket(self, table: str, splits: set[str]) -> Column:
        """The bucket of a row: as many further bits as there are splits on its way."""
        h = F.xxhash64(F.col(self.specs[table].bucket_by))
        by_depth: dict[int, list[int]] = {}
        for d, v in (map(int, s.split("-")) for s in splits):
            by_depth.setdefault(d, []).append(v)
        depth = F.lit(self.depth)
        for d, values in sorted(by_depth.items()):
            depth = depth + F.pmod(h, F.lit(1 << d)).isin(values).cast("int")
        return F.concat(depth.cast("string"), F.lit("-"), F.pmod(h, F.pow(F.lit(2), depth).cast("long")).cast("string"))

    def _size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength()

    def _writer(self, spec: TableSpec, rows: DataFrame):
        out = rows.write
        for c in spec.bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        return out.option("parquet.bloom.filter.adaptive.enabled", "true") if spec.bloom else out  # as large as the file's values ask

    def write(self, table: str, rows: DataFrame, splits: set[str] | None = None, named: set[str] | None = None) -> tuple[dict[str, dict], set[str]]:
        """Rows as new folders by bucket, seen by nobody until a version names them, and the splits with those of new large buckets."""
        spec, splits = self.specs[table], set(splits or ())
        validate_schema(rows, spec.schema)
        way = splits if named is None else {_bucket(d, int(b.split("-")[1]) % (1 << d)) for b in named for d in range(self.depth, int(b.split("-")[0]))}
        written = self._dealt(table, rows, way)
        if named is not None and (stray := written.keys() - named):
            raise ValueError(f"rows of {table} belong to buckets that the change doesn't name: {sorted(stray)}")
        large = {b: max(1, math.ceil(math.log2(p["bytes"] / self.bucket_bytes))) for b, p in written.items() if p["bytes"] > self.bucket_bytes and spec.bucket_by}
        large = {b: n for b, n in large.items() if int(b.split("-")[0]) + n < 48}
        if large:
            fresh = set().union(*(_children(b, n) for b, n in large.items()))
            again = self._dealt(table, self.rows_of(table, [written[b]["path"] for b in large]), way | fresh)
            for b in large:
                self._fs.delete(self._path(written.pop(b)["path"]), True)
            written |= again
            splits |= fresh
        return written, splits

    def _dealt(self, table: str, rows: DataFrame, splits: set[str]) -> dict[str, dict]:
        spec = self.specs[table]
        folder = f"data/{table}-{uuid.uuid4().hex}"
        if spec.bucket_by is None:
            self._writer(spec, rows.select(*spec.schema.fieldNames())).parquet(f"{self.path}/{folder}")
            return {_bucket(0, 0): {"path": folder, "bytes": self._size(folder)}}
        dealt = rows.select(*spec.schema.fieldNames()).withColumn("__bucket", self.bucket(table, splits)).hint("rebalance", "__bucket")
        if spec.sort_by:
            dealt = dealt.sortWithinPartitions("__bucket", *spec.sort_by)
        self._writer(spec, dealt).partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        paths = {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("__bucket=")}
        return {b: {"path": p, "bytes": self._size(p)} for b, p in paths.items()}

    def write_added(self, table: str, rows: DataFrame) -> dict | None:
        """Rows as one more part of a table with sums; None without rows."""
        spec, folder = self.specs[table], f"data/{table}-{uuid.uuid4().hex}"
        if spec.sums is None:
            raise ValueError(f"rows can't be added to {table}")
        validate_schema(rows, spec.schema)
        self._writer(spec, rows.select(*spec.schema.fieldNames()).sort(*(spec.sort_by or (spec.bucket_by,)))).parquet(f"{self.path}/{folder}")
        return {"path": folder, "bytes": self._size(folder)}

    def publish(self, next_: Snapshot) -> Snapshot:
        """Make ``next_`` the current version, unless another followed the version before it."""
        numbers, late = self._numbers(), f"a version after {next_.number - 1} was published meanwhile"
        if (numbers[-1] if numbers else -1) != next_.number - 1:
            raise ConcurrentChange(late)
        before = self._load(numbers[-1]) if numbers else None
        content = {"parts": next_.parts, "added": next_.added, "splits": next_.splits, "applied": next_.applied}
        if not self._put(f"_versions/{next_.number:012d}", json.dumps(content)):
            raise ConcurrentChange(late)
        if self._numbers()[-1] > next_.number:  # the number was free only because a later version had it deleted
            self._fs.delete(self._path(f"_versions/{next_.number:012d}"), False)
            raise ConcurrentChange(late)
        self._purge(next_, before)
        return next_

    @staticmethod
    def _paths(version: Snapshot) -> set[str]:
        return {p["path"] for t in version.parts.values() for p in t.values()} | {p["path"] for t in version.added.values() for p in t}

    def _purge(self, now: Snapshot, before: Snapshot | None) -> None:
        """Delete what only versions before the last two name, then their pointers."""
        needed = self._paths(now) | (self._paths(before) if before else set())
        for number in (n for n in self._numbers() if n < (before or now).number):
            for path in self._paths(self._load(number)) - needed:
                self._fs.delete(self._path(path), True)
            self._fs.delete(self._path(f"_versions/{number:012d}"), False)

    def vacuum(self, hours: float) -> int:
        """Delete what writers left behind that failed: folders of data that no version names and that are older; how many."""
        named = {p.split("/")[1] for n in self._numbers() for p in self._paths(self._load(n))}
        before = (time.time() - hours * 3600) * 1000
        gone = [s.getPath() for s in (self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []) if s.getPath().getName() not in named and s.getModificationTime() < before]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


class SnapshotTable:
    """A store of one table."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, bucket_by: str, buckets: int = BUCKETS):
        self.store = SnapshotStore(spark, path, {"rows": TableSpec(schema, bucket_by)}, buckets)

    def read(self) -> DataFrame:
        return self.store.begin().read("rows")

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows`` the content; they may be derived from the present content."""
        self.store.begin().commit({"rows": (rows, None)})

    def upsert(self, rows: DataFrame, *keys: str, order: Column | None = None) -> None:
        """Put in rows by their keys, which must hold the bucket column; other buckets aren't read."""
        from ..operators.lifecycle import upsert

        if self.store.specs["rows"].bucket_by not in keys:
            raise ValueError("rows with equal keys must share a bucket")
        now = self.store.begin()
        touched = now.touched(rows, "rows")["rows"]
        now.commit({"rows": (upsert(now.read("rows", touched), rows, *keys, order=order), touched)})


class LogTable:
    """An append-only Parquet table, partitioned by the day of a timestamp so that recent windows read few files."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, at: str = "created_at"):
        self.spark, self.path, self.schema, self.at = spark, path, schema, at

    def append(self, rows: DataFrame) -> None:
        validate_schema(rows, self.schema)
        rows.withColumn("day", F.to_date(self.at)).write.mode("append").partitionBy("day").parquet(self.path)

    def read(self, since: str | None = None) -> DataFrame:
        out = self.spark.read.parquet(self.path)
        if since is not None:
            out = out.where((F.col("day") >= F.to_date(F.lit(since))) & (F.col(self.at) >= F.lit(since).cast("timestamp")))
        return out.select(*self.schema.fieldNames())


def retrieve(points: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Payload columns of the points with given chunk ids; unknown ids are dropped."""
    return points.select("chunk_id", *columns).join(ids.select("chunk_id").distinct(), "chunk_id")
