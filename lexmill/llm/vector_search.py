"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is centred, rotated (shorter ones into CODE_BITS dimensions) and reduced to the
signs of its components: packed bits plus three scalars (length, alignment of the code with
the vector, product with the centre). From these an inner product is estimated with a bound
on its error. A first pass over a share of the rows finds each query's k-th best exact
score so far; the second pass, over codes alone, keeps the rows whose upper bound reaches
it, and only those meet their vectors to be scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, discard, map_batches, small, store, struct

#: Standard deviations of the estimate that its error bound spans; bits of a code at least; rows
#: and bytes of rows that fit the centre (a bounded sample); rows and queries that meet in one task.
BOUND, CODE_BITS, FIT_ROWS, FIT_BYTES, BLOCK_ROWS, BLOCK_QUERIES = 2.0, 256, 10_000, 8 << 20, 16_384, 4_096
#: The share of the rows in the first pass, and its rows at least.
FIRST_SHARE, FIRST_ROWS = 1 / 32, 16_384


def usable(vector: Column, dims: int) -> Column:
    """Not null, of ``dims`` finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def rotation(dims: int, seed: int, bits: int = CODE_BITS) -> np.ndarray:
    """Orthonormal rows: a random rotation of vectors that are filled up with zeros to ``bits`` components, where they have fewer."""
    size = -(-max(dims, bits) // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return (q * np.sign(np.diag(r)))[:dims]


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(packed bits, length, alignment, product with the centre) of each vector."""
    rest = vectors - centre
    length = np.sqrt((rest * rest).sum(1))
    unit = rest / np.maximum(length, 1e-300)[:, None] @ turn
    align = np.abs(unit).sum(1) / np.sqrt(turn.shape[1])
    align[length == 0] = 1.0  # the estimate is exact there
    return np.packbits(unit > 0, axis=1), length, align, vectors @ centre


def estimate(bits: np.ndarray, length: np.ndarray, align: np.ndarray, offset: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x rows) and the error of one standard deviation (same shape)."""
    size = turn.shape[1]
    signs = (np.unpackbits(bits, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(size))
    rest = queries - centre
    turned = (rest @ turn).astype(np.float32)
    got = turned @ signs.T
    got *= (length / align).astype(np.float32)
    got += offset.astype(np.float32)
    got += (queries @ centre - centre @ centre).astype(np.float32)[:, None]
    spread = length * np.sqrt(np.maximum(0.0, 1 - align**2)) / align / np.sqrt(max(1, size - 1))
    return got, np.sqrt((rest * rest).sum(1)).astype(np.float32)[:, None] * spread.astype(np.float32)


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal vectors get equal scores."""
    return (vectors * query).sum(1)


def reachable(codes: tuple, queries: np.ndarray, floors: np.ndarray, centre: np.ndarray, turn: np.ndarray, bound: float):
    """(first query, estimates, upper bounds, mask of queries x rows) by steps of queries; the mask has rows whose upper bound reaches the query's floor."""
    step = max(1, 4_000_000 // max(1, len(codes[0])))
    for lo in range(0, len(queries), step):
        guess, error = estimate(*codes, queries[lo : lo + step], centre, turn)
        error *= np.float32(bound)
        error += guess
        yield lo, guess, error, error >= (floors[lo : lo + step] - 1e-5).astype(np.float32)[:, None]


def nearest(ids: np.ndarray, vectors: np.ndarray, codes: tuple, query_ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, bound: float | None):
    """(query place, row places, scores, rows scored) of each query's k best rows of this block, best first.

    The rows with the best estimates are scored first; their k-th best score is the floor
    that others' upper bounds must reach. Without a bound all rows are scored.
    """
    floors = np.full(len(queries), -np.inf)
    for lo, guess, *_ in reachable(codes, queries, floors, centre, turn, 0.0) if bound is not None else ():
        last = min(2 * k, len(ids) - 1)
        tops = np.argpartition(-guess, last, axis=1)[:, : last + 1]
        for i, top in enumerate(tops, lo):
            top = top[ids[top] != query_ids[i]]
            if len(top) >= k:
                floors[i] = np.sort(exact(queries[i], vectors[top]))[-k]
    for lo, *_, mask in reachable(codes, queries, floors, centre, turn, bound or 0.0):
        for i, hit in enumerate(mask, lo):
            places = np.flatnonzero(hit & (ids != query_ids[i]))
            scores = exact(queries[i], vectors[places])
            best = np.lexsort((ids[places], -scores))[:k]
            yield i, places[best], scores[best], len(places)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", bound: float | None = BOUND, seed: int = 11, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, first_rows: int = FIRST_ROWS) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` rows of largest inner product, best first.

    All rows are coded and scanned; a row is lost only where its estimate is off by more
    than ``bound`` standard deviations; with ``bound=None`` none is, as every row is scored. Scores
    are exact products of the original vectors; ties go to the smaller id. A row with
    the query's own id is no candidate of it. Vectors that are null, zero, of another size than
    most, or hold null or non-finite components take no part. Rows repeated under one id
    are candidates each; of rows with equal vectors only those of the k + 1 smallest ids are
    scanned, as no other can be among the k best of any query. Query ids that repeat are
    searched once, with the smallest of their vectors; null ids take no part; other columns
    aren't read; an empty table gives no rows.

    Rows and queries meet in blocks: each task has one block of rows and one of queries,
    so no task and no broadcast grows with the data; beyond the first pass a block of rows
    holds codes, not vectors. Of what reaches a query's floor the 2 k rows of the best estimates meet
    their vectors first, the others only if they reach the floor that these set. The centre is fitted on at most FIT_ROWS rows, the first by a
    hash of their id.
    """
    out = struct(query_id="long", rank="int", **{id_col: "long"}, score="double")
    spark = vectors.sparkSession
    column = F.col(vector_col)
    dims = vectors.where(column.isNotNull()).agg(F.mode(F.size(column)).alias("d")).first()["d"]
    if not dims:
        return spark.createDataFrame([], out)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), column.cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dims))
    same = Window.partitionBy(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).orderBy("id")
    base = base.withColumn("turn", F.dense_rank().over(same)).where(F.col("turn") <= k + 1).drop("turn")
    asked = queries.select(F.col(id_col).cast("long").alias("qid"), column.cast("array<double>").alias("q")).where(F.col("qid").isNotNull() & usable(F.col("q"), dims)).groupBy("qid").agg(F.min("q").alias("q"))
    sample = base.orderBy(F.xxhash64("id"), "id", "v").limit(max(1, min(FIT_ROWS, FIT_BYTES // (8 * dims)))).select("v").toPandas()["v"]
    centre = np.stack(sample.to_numpy()).mean(0) if len(sample) else np.zeros(dims)
    turn = rotation(dims, seed)

    coded = struct(id="long", v="array<double>", bits="binary", length="double", align="double", offset="double")

    def code(batch):
        x = matrix(batch.column("v"), dims)
        bits, length, align, offset = encode(x, centre, turn)
        yield arrow_batch(coded, {"id": batch.column("id"), "v": batch.column("v"), "bits": [b.tobytes() for b in bits], "length": length, "align": align, "offset": offset})

    index = store(map_batches(base, code, coded).withColumn("place", F.monotonically_increasing_id()), "vector-index")
    asked = store(asked, "vector-queries")
    n, n_asked = index.count(), asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], out)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "place"), 11) / F.lit(float(1 << 53))
    share = 1.0 if bound is None else min(1.0, max(FIRST_SHARE, first_rows / n))
    codes_of = ("id", "place", "bits", "length", "align", "offset")

    def blocks(rows: DataFrame, probes: DataFrame, n_rows: float):
        """Both sides dealt out so that every block of rows meets every block of queries."""
        row_blocks, query_blocks = max(1, math.ceil(n_rows / block_rows)), -(-n_asked // block_queries)
        left = rows.withColumn("rb", F.pmod(F.xxhash64("place"), F.lit(row_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        right = probes.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        return left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb"))

    def codes(t: pa.Table) -> tuple:
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return bits, t["length"].to_numpy(), t["align"].to_numpy(), t["offset"].to_numpy()

    def gathered(schema, got: list[tuple]) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*got)] if got else [[] for _ in schema.fieldNames()]
        return pa.Table.from_batches([arrow_batch(schema, dict(zip(schema.fieldNames(), columns)))])

    found = struct(qid="long", id="long", score="double")

    def with_vectors(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, x = left["id"].to_numpy(), matrix(left["v"], dims)
            qids, q = right["qid"].to_numpy(), matrix(right["q"], dims)
            for i, places, scores, _ in nearest(ids, x, codes(left), qids, q, centre, turn, k, bound):
                got.append((np.full(len(places), qids[i]), ids[places], scores))
        return gathered(found, got)

    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = lambda rows: rows.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
    first = blocks(index.where(draw < share).select(*codes_of, "v"), asked, n * share).applyInArrow(with_vectors, found)
    if share >= 1.0:
        return named(top(first))

    first = store(top(first).drop("rank"), "vector-first")
    floors = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    probes = asked.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    hits = struct(qid="long", place="long", guess="float", upper="float")

    def with_codes(left: pa.Table, right: pa.Table) -> pa.Table:
        got: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, places = left["id"].to_numpy(), left["place"].to_numpy()
            qids, q = right["qid"].to_numpy(), matrix(right["q"], dims)
            for lo, guess, upper, mask in reachable(codes(left), q, right["floor"].to_numpy(), centre, turn, bound):
                mask &= ids[None, :] != qids[lo : lo + len(mask), None]
                at, hit = np.nonzero(mask)
                got.append((qids[lo + at], places[hit], guess[mask], upper[mask]))
        return gathered(hits, got)

    def score(batch):
        yield arrow_batch(found, {"qid": batch.column("qid"), "id": batch.column("id"), "score": exact(matrix(batch.column("q"), dims), matrix(batch.column("v"), dims))})

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.select("qid", "place").join(index.select("place", "id", "v"), "place").select("qid", "id", "v").join(small(asked, n_asked, 8 * dims + 32, 8 << 20), "qid")
        return map_batches(met.select("qid", "id", "v", "q"), score, found)

    second = store(blocks(index.where(draw >= share).select(*codes_of), probes, n * (1 - share)).applyInArrow(with_codes, hits), "vector-hits")
    # the best estimates meet their vectors first, and raise the floor that the others must reach
    by_guess = Window.partitionBy("qid").orderBy(F.col("guess").desc(), "place")
    likely = store(second.withColumn("turn", F.row_number().over(by_guess)).where(F.col("turn") <= 2 * k).select("qid", "place"), "vector-likely")
    better = store(top(first.unionByName(scored(likely))).drop("rank"), "vector-better")
    raised = better.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    left = second.join(small(raised, n_asked, 24), "qid", "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor") - 1e-5))
    rest = store(left.select("qid", "place").join(likely, ["qid", "place"], "left_anti"), "vector-rest")
    discard(second)
    return named(top(better.unionByName(scored(rest))))
