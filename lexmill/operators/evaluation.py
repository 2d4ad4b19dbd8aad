"""Retrieval quality: is a chunk found by its own questions?"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Chunks and questions that meet in one task at most; questions of fewer blocks than these are dealt out finer.
BLOCK, FINE_BLOCK, QUESTION_BLOCKS = 65_536, 4_096, 64
#: Questions and chunks that are multiplied at once.
TILE = 1_024, 8_192


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.asarray(column.combine_chunks().flatten(), np.float64).reshape(len(column), -1)
    return flat / np.sqrt((flat * flat).sum(1))[:, None]


def _ahead(q: np.ndarray, of: np.ndarray, target: np.ndarray, w: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many chunks come before each question's own; single precision tells, but for products so near the target that it can't."""
    ahead, q32, w32 = np.zeros(len(q), np.int64), q.astype(np.float32), w.astype(np.float32)
    margin = (q.shape[1] + 4) * 2.0**-23 + 1e-9  # twice what unit vectors' products may be off by, and the rounding to 9 digits
    for at in range(0, len(q), TILE[0]):
        mine = slice(at, at + TILE[0])
        lower, upper = ((target[mine] + m).astype(np.float32)[:, None] for m in (-margin, margin))
        for start in range(0, len(w), TILE[1]):
            score = q32[mine] @ w32[start : start + TILE[1]].T
            sure = score > upper
            ahead[mine] += [np.count_nonzero(row) for row in sure]
            i, j = np.nonzero((score >= lower) ^ sure)
            i, j = i + at, j + start
            exact = np.round((q[i] * w[j]).sum(1), 9)
            before = (exact > target[i]) | ((exact == target[i]) & (ids[j] < of[i]))  # of equal scores, smaller ids come first
            np.add.at(ahead, i[before & (ids[j] != of[i])], 1)
    return ahead


def _blocks(chunks: int, questions: int, block: int) -> tuple[int, int]:
    """Blocks of chunks and of questions; a chunk goes to all of the latter, a question to all of the former."""
    return max(1, -(-chunks // block)), max(1, -(-questions // block), min(QUESTION_BLOCKS, -(-questions // FINE_BLOCK)))


def retrieval_quality(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(questions, recall_1, recall_5, mrr) over lane vectors (chunk_id, ordinal, v).

    Every question vector ranks all chunk vectors by cosine (to 9 digits); ties go to the
    smaller chunk id. Ranks are counted, not sorted: the chunks that come before the
    question's own. Chunks and questions meet in blocks, so no task holds either side whole;
    every row goes to as many tasks as the other side has blocks.
    Zero vectors, and questions whose chunk has no vector, take no part.
    """
    live = vectors.where(F.exists("v", lambda x: x != 0))
    own = live.where("ordinal < 0").select(F.col("chunk_id").alias("found"), F.col("v").alias("w"))
    paired = live.where("ordinal >= 0").select(F.col("chunk_id").alias("of"), F.col("ordinal").cast("int").alias("ordinal"), F.col("v").alias("q")).join(own.select(F.col("found").alias("of"), F.col("w").alias("t")), "of")
    kind = T.StructType([*paired.schema.fields[:3], T.StructField("target", T.DoubleType())])
    result = T.StructType([*paired.schema.fields[:2], T.StructField("ahead", T.LongType())])

    def aimed(batches):
        for batch in batches:
            some = pa.Table.from_batches([batch])
            target = np.round((_unit(some["q"]) * _unit(some["t"])).sum(1), 9) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(target)], names=kind.fieldNames())

    rows, queries = _blocks(own.count(), paired.count(), block)
    place = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    left = own.withColumn("rb", place(rows, "found")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))))
    right = paired.mapInArrow(aimed, kind).withColumn("qb", place(queries, "of", "ordinal")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    arrow = to_arrow_schema(result)

    def count(chunks: pa.Table, questions: pa.Table) -> pa.Table:
        ahead = np.zeros(questions.num_rows, np.int64)
        if chunks.num_rows and questions.num_rows:
            of, ids = (np.array(x.to_pylist(), object) for x in (questions["of"], chunks["found"]))
            ahead = _ahead(_unit(questions["q"]), of, np.asarray(questions["target"]), _unit(chunks["w"]), ids)
        return pa.Table.from_arrays([questions["of"], questions["ordinal"], pa.chunked_array([ahead])], schema=arrow)

    ahead = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(count, result)
    ranked = ahead.groupBy("of", "ordinal").agg((F.sum("ahead") + 1).alias("rank"))
    share = lambda k: F.round(F.avg((F.col("rank") <= k).cast("int")), 6)
    return ranked.agg(F.count(F.lit(1)).alias("questions"), share(1).alias("recall_1"), share(5).alias("recall_5"), F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))
