"""Winnowed document fingerprints: rolling k-gram hashes, the minimum of each window, positions kept."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, map_batches, slices, struct, texts_of
from .ordering import bounds_of, parts_of, range_of

#: Code points of a gram, and grams of a window: texts that share WINDOW + GRAM - 1
#: consecutive code points share a fingerprint hash. A text's window is an eighth of its
#: grams within these bounds, so that short texts keep several hashes; a smaller window keeps all
#: hashes that a larger one does, so the guarantee holds between texts of any lengths.
GRAM = 16
LEAST_WINDOW, WINDOW = 4, 48

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams, from rolling sums of powers, doubled up to k."""
    total, size, power = None, 0, _BASE
    block, width = points.astype(np.uint64) + np.uint64(1), 1
    rest = k
    while rest:
        if rest & 1:  # append a block of ``width`` points to what is summed so far
            if total is None:
                total, size = block, width
            else:
                n = len(points) - size - width + 1
                total = total[:n] * np.uint64(power) + block[size : size + n]
                size += width
        rest >>= 1
        if rest:
            n = len(block) - width
            block = block[:n] * np.uint64(power) + block[width:]
            power = power * power & _MASK
            width *= 2
    x = total[: len(points) - k + 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(32)


def fingerprint(text: str, k: int = GRAM, w: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing keeps of a whole text, by ascending position.

    Each window of ``w`` grams (by the text's length, if not given) keeps its smallest hash, of equal ones the rightmost.
    A text of fewer than ``k`` code points is one gram, of fewer than ``w`` grams one
    window; the empty text has no fingerprint.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes = gram_hashes(points, min(k, n))
    # the hash above the reversed position: the smallest key is the smallest hash, rightmost of ties
    keys = (hashes << np.uint64(32)) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    span = min(w or min(WINDOW, max(LEAST_WINDOW, len(keys) // 8)), len(keys))
    low, width = keys, 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(keys) - span + 1], low[span - width :])
    keep = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return (keep >> np.uint64(32)).astype(np.uint32), (_LOW - (keep & _LOW)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes; two empty ones are equal."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def as_text(hashes: np.ndarray) -> str:
    """The kept hashes in order of position, eight hexadecimal digits each."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = GRAM, w: int | None = None) -> DataFrame:
    """(id, hashes array<long>, positions array<long>) of every whole text.

    A null text is empty and has empty arrays; repeated rows are done each, a null id
    is passed through, other columns aren't read. Long texts are fingerprinted whole; an
    empty table gives no rows. Narrow: no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = struct(id=rows.schema["id"].dataType, hashes="array<long>", positions="array<long>")

    def run(batch):
        out = [fingerprint(t, k, w) for t in texts_of(batch, "text")]
        yield arrow_batch(schema, {"id": batch.column("id"), "hashes": [h.tolist() for h, _ in out], "positions": [p.tolist() for _, p in out]})

    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_neighbours(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = GRAM, w: int | None = None) -> DataFrame:
    """Each text's fingerprint beside that of its edited form and of the next text.

    Next is by ascending (id, text), a null id first; the last is followed by the
    first, and a single row by itself. Rows are dealt out in ranges of the numeric id,
    one shuffle of the texts, and run through in order; the first row of each range is
    also sent to the range before it. A null text is empty, its fingerprint the empty
    string; the likeness of two empty texts is 1, of an empty and another 0. Repeated
    rows follow each other; long texts are taken whole; other columns aren't read; an empty
    table gives no rows. Rows of one id are in one range, so one task reads all rows of a repeated id.
    """
    parts = parts_of(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(-(1 << 63)))
    part = range_of(key, bounds_of(rows, key, parts))
    # one row per range, so at most as many as there are partitions
    firsts = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.min(key).alias("k")).collect())
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}
    guard = F.lit(None).cast("int")
    if before:
        guard = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]).cast("map<bigint,int>"), key)
    own = F.struct(part.alias("part"), F.lit(0).alias("role"))
    ahead = F.struct(guard.alias("part"), F.lit(1).alias("role"))
    dealt = (
        rows.withColumn("__to", F.explode(F.filter(F.array(own, ahead), lambda x: x.part.isNotNull())))
        .select("__to.part", "__to.role", key.alias("k"), "id", "text")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("role", "k", "text")
        .select("role", "id", "text")
    )
    schema = struct(id=rows.schema["id"].dataType, n_chars="long", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double")

    def run(batches):
        names = schema.fieldNames()
        held, done = None, False
        for whole in batches:
            for batch in slices(whole):
                out = {c: [] for c in names}
                for role, doc_id, text in zip(batch.column("role").to_pylist(), batch.column("id").to_pylist(), texts_of(batch, "text")):
                    if done:
                        break
                    mark, _ = fingerprint(text, k, w)
                    if held is not None:
                        old_id, old, old_mark = held
                        changed = edit(old, text)
                        changed_mark, _ = fingerprint(changed, k, w)
                        row = (old_id, len(old), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_text(old_mark), as_text(changed_mark), likeness(old_mark, changed_mark), likeness(old_mark, mark))
                        for c, x in zip(names, row):
                            out[c].append(x)
                    held, done = (doc_id, text, mark), role == 1  # copies of the first row after the guard aren't needed
                if out["id"]:
                    yield arrow_batch(schema, out)

    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
