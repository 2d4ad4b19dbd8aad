"""Target-distribution importance resampling, by a dictionary of distinct features.

Features are runs of words. Each document's features are counted where it is read; these
counts are combined into a dictionary with one row per distinct feature, of how often the
documents and the target texts hold it. Each distinct feature is hashed once, there; the
dictionary's buckets are aggregated, each bucket's gain says how much likelier the target is
to hold its features than the documents are, and the gains are joined back to the documents'
counts by the feature's string.

A feature that holds over 1 / FREQUENT of all occurrences is frequent: there are fewer than
FREQUENT of them, so their gains are sent to all tasks, and no shuffle meets them. What is
left is joined by shuffle, where no key has many rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, discard, heavy_keys, map_batches, pieces, spread_join, store, struct
from .ordering import numbered

#: Frequent features are fewer than this, and of at most so many bytes each.
FREQUENT, FREQUENT_BYTES = 1 << 16, 256
#: Gains of at most so many buckets are broadcast.
MOST_BUCKETS = 1 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: bytes, shortest: int = 1, longest: int = 1) -> tuple[Counter, int]:
    """How often a text holds each run of ``shortest`` to ``longest`` words, and its number of words.

    A-Z are lower-cased; words are runs of a-z, 0-9 and all beyond ASCII, joined by a space.
    """
    found, carried, n = Counter(), [], 0
    for piece in pieces(text):
        words = _WORD.findall(piece.lower())
        n += len(words)
        if longest == shortest == 1:
            found.update(words)
            continue
        words = carried + words
        for k in range(shortest, longest + 1):
            first = max(0, len(carried) - k + 1)  # runs within what was carried are counted
            found.update(b" ".join(words[i : i + k]) for i in range(first, len(words) - k + 1))
        carried = words[max(0, len(words) - longest + 1) :]
    return found, n


def feature_counts(docs: DataFrame, shortest: int = 1, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, n_features, features, counts) of every row; a null text has none. ``row`` tells rows apart once stored."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = struct(id=rows.schema["id"].dataType, n_words="long", n_features="long", features="array<binary>", counts="array<long>")

    def run(batch):
        words, totals, ends, keys, counts = [], [], [0], [], []
        for text in batch.column("text").to_pylist():
            found, n = features(text or b"", shortest, longest)
            words.append(n)
            keys.extend(found.keys())
            counts.extend(found.values())
            ends.append(len(keys))
            totals.append(sum(found.values()))
        of = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
        yield arrow_batch(schema, {"id": batch.column("id"), "n_words": words, "n_features": totals, "features": of(keys, pa.binary()), "counts": of(counts, pa.int64())})

    return map_batches(rows, run, schema).withColumn("row", F.monotonically_increasing_id())


def _flat(counted: DataFrame, *keep: str) -> DataFrame:
    return counted.select(*keep, F.explode(F.arrays_zip("features", "counts")).alias("x")).select(*keep, F.col("x.features").alias("f"), F.col("x.counts").alias("c"))


def dictionary(counted: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """Stored (f, s, t, bucket): each distinct feature, how often documents and target hold it, and its bucket."""
    both = _flat(counted).select("f", F.col("c").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(_flat(target).select("f", F.lit(0).cast("long").alias("s"), F.col("c").alias("t")))
    words = both.groupBy("f").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return store(words.withColumn("bucket", (F.crc32("f") % buckets).cast("int")), "resample-dictionary")


def gains(words: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): floor(1000 * ln of the target's smoothed share by that of the documents)."""
    s_all, t_all = words.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    binned = words.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    ratio = (F.col("t") + 1) * F.lit(float(s_all + buckets)) / ((F.col("s") + 1) * F.lit(float(t_all + buckets)))
    return binned.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(counted: DataFrame, words: DataFrame, buckets: int, frequent: int = FREQUENT) -> DataFrame:
    """(row, id, n_words, n_features, weight): the sum of gains over each row's features, those of none 0."""
    given = gains(words, buckets)
    known = words.where("s > 0").join(F.broadcast(given) if buckets <= MOST_BUCKETS else given, "bucket").select("f", "s", "gain")
    total = words.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    often = (F.col("s") * F.lit(frequent) > F.lit(total)) & (F.octet_length("f") <= FREQUENT_BYTES)
    hot = F.broadcast(known.where(often).select("f", "gain"))
    facts = ["row", "id", "n_words", "n_features"]
    x = F.explode_outer(F.arrays_zip("features", "counts")).alias("x")
    each = counted.select(*facts, x).select(*facts, F.col("x.features").alias("f"), F.col("x.counts").alias("c"))
    first = each.join(hot, "f", "left").groupBy(*facts).agg(F.coalesce(F.sum(F.col("c") * F.col("gain")), F.lit(0)).alias("weight"))
    rest = known.where(~often)
    if not rest.take(1):
        return first
    left = _flat(counted, "row").join(hot.select("f"), "f", "left_anti")
    # a feature of very many bytes may be frequent
    heavy = heavy_keys(rest, "f", total, "s")
    more = spread_join(left, rest.select("f", "gain"), "f", heavy, ("row",)).groupBy("row").agg(F.sum(F.col("c") * F.col("gain")).alias("more"))
    return first.join(more, "row", "left").select(*facts, (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))


def noise(seed: int, id_: Column) -> Column:
    """floor(1000 * a draw of the Gumbel distribution), by a hash of the seed and the id (null as the empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, shortest: int = 1, longest: int = 1,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", frequent: int = FREQUENT,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row: what a sample that looks like ``target`` takes.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) of the
    highest scores are drawn, without replacement: score = weight + noise (Gumbel top-k), ties to
    the smaller id, then to the order of reading. rank is 1, 2, 3, ... in that order, null for
    undrawn rows. Whole texts of any length are read, a piece at a time. Null and empty texts have no
    feature and weight 0; repeated rows are rows of their own; a null id has a draw too,
    that of the empty text, and comes last among ties. An empty target or table is
    smoothed like any other; no rows give no rows. Other columns aren't read.
    """
    # ``row`` is fixed where it is stored
    counted = store(feature_counts(docs, shortest, longest, id_col, text_col), "resample-counts")
    wanted = store(feature_counts(target.withColumn("__id", F.lit(0)), shortest, longest, "__id", target_col), "resample-target")
    words = dictionary(counted, wanted, buckets)
    scored = weights(counted, words, buckets, frequent).withColumn("score", F.col("weight") + noise(seed, F.col("id")))
    scored = store(scored, "resample-scores")
    for done in (counted, wanted, words):
        discard(done)
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    ranked = numbered(scored.where(able), order, name="resample-ranked")
    drawn = F.floor(F.lit(percent) * F.col("n") / 100)
    ranked = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    out = ["id", "n_features", "weight", "score", "rank"]
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out).unionByName(rest.select(*out)).withColumnRenamed("id", id_col)
