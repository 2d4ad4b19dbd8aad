"""Dense search over 8-bit codes of the chunks' vectors, with results that are exact.

A vector is stored as the integers nearest to its unit vector's components over a scale of
its own, a byte each: a quarter of its size. A product with a code differs from the true cosine by
half a scale for each unit of the query's components at most, so that codes give bounds: a row
whose upper bound is below the k-th best lower bound of a lane can't be among its
best. Only what is left meets its original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import bound, doubles
from . import filters, search

#: What the sums themselves may be off by.
ROUNDING = 1e-6


def unit(vector: Column) -> Column:
    """A vector over its length; null for null, empty and zero vectors and for such with null or non-finite components."""

    def scaled(v: Column) -> Column:
        good = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(F.coalesce(good, F.lit(False)), bound(size, lambda s: F.transform(v, lambda x: x / s)))

    return bound(doubles(vector), scaled)


def encoded(vector: Column) -> Column:
    """(code, scale) of a vector: a signed byte a component, and what one step stands for; null where ``unit`` is."""
    step = lambda u: F.aggregate(u, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))) / 127
    byte = lambda x, scale: F.lpad(F.hex(F.pmod(F.round(x / scale).cast("int"), F.lit(256))), 2, "0")
    code = lambda u, scale: F.unhex(F.array_join(F.transform(u, lambda x: byte(x, scale)), ""))
    return bound(unit(vector), lambda u: F.when(u.isNotNull(), bound(step(u), lambda scale: F.struct(code(u, scale).alias("code"), scale.alias("scale")))))


def with_codes(points: DataFrame, vector: str = "chunk_vector") -> DataFrame:
    """Points with chunk_code and chunk_scale."""
    made = points.withColumn("__code", encoded(F.col(vector)))
    return made.withColumns({"chunk_code": F.col("__code.code"), "chunk_scale": F.col("__code.scale")}).drop("__code")


class _Lanes:
    """Lower bounds of each query's lanes so far, and what may still be among their best."""

    def __init__(self, block: search._Asked, keep: int, balanced: int | None):
        self.block = block
        self.apart = np.array([balanced is not None and c is None for c in block.category], bool)
        self.depth = np.where(self.apart, balanced or 0, keep)
        self.off = np.abs(block.unit).sum(1) / 2
        self.codes: dict[str | None, int] = {}
        self.best: dict[tuple[int, int], np.ndarray] = {}

    def found(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) numbers of what may be among the best, by the bounds so far."""
        category = np.array(rows["category"].to_pylist(), object)
        admitted = self.block.admitted(rows["audience"].to_pylist(), rows["topics"].to_pylist(), category)
        codes = np.frombuffer(b"".join(rows["chunk_code"].to_pylist()), np.int8).reshape(rows.num_rows, -1).astype(np.float32)
        scale = np.asarray(rows["chunk_scale"])[:, None]
        guess, off = (codes @ self.block.unit.T.astype(np.float32)) * scale, scale * self.off[None, :] + ROUNDING
        lower, upper = np.where(admitted, guess - off, -np.inf), np.where(admitted, guess + off, -np.inf)
        lane = np.array([self.codes.setdefault(c, len(self.codes) + 1) for c in category])
        out = []
        for code in {0, *lane.tolist()} - ({0} if self.apart.all() else set()):
            places = np.arange(len(lane)) if code == 0 else np.flatnonzero(lane == code)
            for q in np.flatnonzero(self.apart == (code != 0)):
                k = int(self.depth[q])
                held = np.concatenate([self.best.get((code, q), np.zeros(0)), lower[places, q]])
                if len(held) > k:
                    held = np.partition(held, -k)[-k:]
                self.best[code, q] = held
                floor = held.min() if len(held) == k else -np.inf
                at = places[upper[places, q] >= floor]
                at = at[np.isfinite(upper[at, q])]
                out.append((at, np.full(len(at), q), lower[at, q], upper[at, q]))
        if not out:
            return tuple(np.zeros(0, t) for t in (int, int, float, float))
        return tuple(np.concatenate(x) for x in zip(*out))


def quantized_best(points: DataFrame, queries: DataFrame, dims: int, keep: int, balanced: int | None = None) -> DataFrame:
    """Cosines (keys, chunk_id, category, q_category, score) that may be among each lane's best, the chunks' vectors scanned as codes.

    Lanes and filters are those of ``dense_best`` for chunk vectors, and so are the results
    after ranking; vectors of another size, and such without a code, take no part. Queries are
    sent to the tasks, which keep no more than their lanes' bounds; for queries that are too many to be
    sent the vectors themselves are searched.
    """
    asked = search._asked(queries, "vector").withColumn("q_vector", doubles(F.col("q_vector")))
    asked = asked.where((F.size("q_vector") == dims) & F.exists("q_vector", lambda x: x != 0))
    keys = [c for c in ("query_id", "variant_id") if c in queries.columns]
    coded = points.where(filters.actual() & (F.octet_length("chunk_code") == dims)).select("chunk_id", "category", "audience", "topics", "chunk_code", "chunk_scale")
    schema = T.StructType([*[asked.schema[k] for k in keys], coded.schema["chunk_id"], coded.schema["category"], asked.schema["q_category"], T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])
    if asked.count() * (8 * dims + 200) > search.BROADCAST_BYTES:
        vectors = search.lane_vectors(points, questions=False)
        return search.dense_best(vectors, queries, dims, (keep, keep), balanced and (balanced, balanced)).drop("ordinal")
    arrow, table = to_arrow_schema(schema), asked.toArrow()

    def scan(batches):
        lanes = [_Lanes(search._Asked(table.slice(at, search.BLOCK_QUERIES), keys), keep, balanced) for at in range(0, table.num_rows, search.BLOCK_QUERIES)]
        for batch in batches:
            for at in range(0, batch.num_rows, search.BLOCK_ROWS):
                rows = batch.slice(at, search.BLOCK_ROWS)
                for some in lanes:
                    place, q, lower, upper = some.found(rows)
                    whose = some.block.table.take(pa.array(q, pa.int64()))
                    given = rows.take(pa.array(place, pa.int64()))
                    columns = [whose[k].combine_chunks() for k in keys] + [given["chunk_id"], given["category"], whose["q_category"].combine_chunks(), pa.array(lower), pa.array(upper)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    if not table.num_rows:
        hits = queries.sparkSession.createDataFrame([], schema)
    else:
        hits = coded.mapInArrow(scan, schema)
    apart = F.col("q_category").isNull() & F.lit(balanced is not None)
    lane = F.when(apart, F.coalesce("category", F.lit("")))
    depth = F.when(apart, F.lit(balanced)).otherwise(F.lit(keep))
    order = Window.partitionBy(*keys, "lane").orderBy(F.col("lower").desc())
    ranked = hits.withColumn("lane", lane).withColumn("i", F.row_number().over(order))
    floor = F.max(F.when(F.col("i") == depth, F.col("lower"))).over(Window.partitionBy(*keys, "lane"))
    left = ranked.withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).select(*keys, "chunk_id", "category", "q_category")
    own = points.where(filters.actual()).select("chunk_id", unit(F.col("chunk_vector")).alias("u"))
    wanted = asked.select(*keys, unit(F.col("q_vector")).alias("w"))
    both = left.join(own, "chunk_id").join(F.broadcast(wanted), keys)
    product = F.aggregate(F.zip_with("u", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return both.select(*keys, "chunk_id", "category", "q_category", product.alias("score"))
