"""SimHash near-duplicates, by an inverted index on positional bytes with count filtering.

Fingerprints of 64 bits link where few bits differ. At most three differing bits touch at
most three of the eight bytes, so a link shares five positional bytes at least: the guaranteed
minimum. Posting lists of one byte would be 1/256 of all fingerprints; the index has lists
of four positional bytes instead, for the 14 sets of four positions of which every five
positions hold one (the blocks of a Steiner system). The fingerprints of a list tally the
positional bytes that they share, pairs that reach the minimum are verified by their bits,
and a list hands back the links that span its components, not its pairs.

A list of more than LIST fingerprints holds a group of near copies, and is not compared. Its
fingerprints meet as balls, wherever they are: two at most 2 bits apart differ from some
common value in one bit each, so fingerprints that name the same value are all linked.
What they join are components; only fingerprints outside the largest component of a long
list then name the values two bits away too, where they meet those one bit from it. Every
pair of a long list is covered: within a component nothing need be found, and of two in
different ones, one at least is outside the largest.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, discard, heavy_keys, map_batches, measured, pieces, spread_join, store, struct
from .components import connected_components

#: Bits that may differ at most for the index to be complete.
MOST_BITS = 3
#: Fingerprints of a list that are compared with each other.
LIST = 4_096
#: Hashes whose bits are counted at once, and fingerprints that are compared with a list at once.
HASHES, ROWS = 1 << 16, 256


def position_sets() -> list[tuple[int, ...]]:
    """Sets of four of the eight bytes such that any five bytes hold one of them.

    Two halves of four: each half, and every two pairs of one half and the other that are in
    matchings of the same number. Five bytes hold a half, or three of one and two of the other:
    the two are in one matching, whose counterpart has a pair within the three.
    """
    matching = lambda h, i: [(h, h + i), tuple(h + j for j in range(1, 4) if j != i)]
    pairs = [(*p, *q) for i in (1, 2, 3) for p in matching(0, i) for q in matching(4, i)]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *pairs]


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles; 0 for a text without words."""
    ones, n, carried = np.zeros(64, np.int64), 0, []

    def count(shingles: list[bytes]) -> None:
        for at in range(0, len(shingles), HASHES):
            h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles[at : at + HASHES]], ">u8")
            ones[:] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)

    for piece in pieces(text):
        found = carried + piece.lower().split()  # bytes are split at the white space that is meant
        joined, ends = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(found)]
        shingles = [joined[a:b] for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]
        count(shingles)
        n += len(shingles)
        carried = found[max(0, len(found) - words + 1) :]
    if not n and carried:
        count([b" ".join(carried)])
        n = 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = struct(id=rows.schema["id"].dataType, fp="long")

    def run(batch):
        found = np.array([fingerprint(t or b"", words, seed) for t in batch.column("text").to_pylist()], np.uint64)
        yield arrow_batch(schema, {"id": batch.column("id"), "fp": pa.array(found.view(np.int64))})

    return map_batches(rows, run, schema)


def _index(fps: DataFrame) -> DataFrame:
    """(k, fp): the lists that each fingerprint is in; a set of positions and what it holds there make a key."""
    keys = []
    for number, positions in enumerate(position_sets()):
        mask = sum(0xFF << (56 - 8 * p) for p in positions)
        held = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        keys.append(F.xxhash64(F.lit(number), held))  # keys that clash only make a list longer
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k", "fp")


def linked_in(fps: np.ndarray, bits: int) -> np.ndarray:
    """For each of a list's fingerprints a smaller number of one that it is connected with, or its own.

    Positional bytes that two share are tallied; pairs that share 8 - ``bits`` are verified.
    """
    root = np.arange(len(fps))
    columns = fps.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(fps), ROWS):
        some = slice(at, at + ROWS)
        tally = np.zeros((len(root[some]), len(fps)), np.uint8)
        for p in range(8):
            tally += columns[some, p, None] == columns[None, :, p]
        x, y = np.nonzero(tally >= 8 - bits)
        x += at
        x, y = x[x > y], y[x > y]
        near = np.bitwise_count(fps[x] ^ fps[y]) <= bits
        x, y = x[near], y[near]
        while len(x):  # the larger root of each link is put under the smaller
            a, b = root[x], root[y]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            open_ = root[x] != root[y]
            x, y = x[open_], y[open_]
    return root


def _compared(lists: DataFrame, bits: int) -> DataFrame:
    """(a, b): links that span the components of each list, from lists (fps)."""
    schema = struct(a="long", b="long")

    def run(batch):
        ends = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for listed in batch.column("fps"):
            fps = np.sort(listed.values.to_numpy(zero_copy_only=False)).view(np.uint64)
            root = linked_in(fps, bits)
            moved = np.flatnonzero(root != np.arange(len(root)))
            ends.append((fps[moved].view(np.int64), fps[root[moved]].view(np.int64)))
        a, b = (np.concatenate(x) for x in zip(*ends))
        yield arrow_batch(schema, {"a": pa.array(a), "b": pa.array(b)})

    return map_batches(lists, run, schema)


def _ball(fp: Column, radius: int) -> Column:
    """All values that differ from ``fp`` in at most ``radius`` bits."""
    masks = [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(64), r)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    return F.transform(signed, lambda m: fp.bitwiseXOR(m))


def _ball_links(members: DataFrame, bits: int) -> DataFrame:
    """Stored (a, b): links that connect what long lists hold, from their entries (k, fp)."""
    inner, outer = bits // 2, bits - bits // 2
    hot = store(members.select("fp").distinct(), "simhash-hot")
    named = hot.select("fp", F.explode(_ball(F.col("fp"), inner)).alias("z"))
    centres = store(named.groupBy("z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("count")), "simhash-balls")
    # at most as many share a value as a ball has, so no key has many rows
    first = named.join(centres.where("count > 1"), "z").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    first = store(first, "simhash-links")
    part = connected_components(first).withColumnRenamed("node", "fp")
    labelled = store(hot.join(part, "fp", "left").withColumn("c", F.coalesce("component", "fp")).select("fp", "c"), "simhash-parts")
    sized = members.join(labelled, "fp").groupBy("k", "c").agg(F.count(F.lit(1)).alias("size"))
    most = sized.groupBy("k").agg(F.max(F.struct("size", "c")).alias("m")).select("k", F.col("m.c").alias("main"))
    inside = members.join(labelled, "fp").join(measured(most), "k")
    outside = store(inside.where("c <> main").select("fp").distinct(), "simhash-outside")
    far = outside.select("fp", F.explode(_ball(F.col("fp"), outer)).alias("z")).join(centres.select("z", "a"), "z").where("fp <> a").select("a", F.col("fp").alias("b"))
    links = store(first.unionByName(far.distinct()), "simhash-links")
    for done in (hot, centres, first, labelled, outside):
        discard(done)
    return links


def links(fps: DataFrame, bits: int = MOST_BITS, most: int = LIST) -> DataFrame:
    """Stored (a, b): links among distinct fingerprints (fp) that connect all that are connected, not all links."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} bits may differ")
    index = _index(fps)
    long = store(index.groupBy("k").count().where(F.col("count") > most).select("k"), "simhash-long")
    hot = bool(long.take(1))
    whole = index.join(measured(long), "k", "left_anti") if hot else index
    lists = whole.groupBy("k").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")
    found = store(_compared(lists, bits).distinct(), "simhash-found")
    if not hot:
        discard(long)
        return found
    members = store(index.join(measured(long), "k"), "simhash-members")
    more = _ball_links(members, bits)
    both = store(found.unionByName(more), "simhash-found")
    for done in (long, members, found, more):
        discard(done)
    return both


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text", most: int = LIST) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Rows link where their fingerprints differ in at most ``bits`` bits; component_id is
    the smallest id that links lead to, the row's own included. No link is lost. A
    fingerprint is that of the whole text, of any length, in shingles of ``words`` words with
    repeats; fewer words are one shingle, and null, empty and wordless texts have fingerprint
    zero, which links like any other. Repeated rows link; a null id takes no part in links
    and has no component. Other columns aren't read; an empty table gives no rows.
    """
    coded = store(fingerprints(docs, words, seed, id_col, text_col), "simhash-fingerprints")
    same = store(coded.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "simhash-distinct")
    found = links(same.select("fp"), bits, most)
    part = connected_components(found)
    discard(found)
    whole = same.join(part.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    first = whole.groupBy("c").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n"))
    # a component may hold very many fingerprints, and a fingerprint very many rows
    parts = heavy_keys(first, "c", same.count(), "n")
    named = spread_join(whole.select("fp", "c"), first.select("c", "least"), "c", parts, ("fp",)).select("fp", "least")
    heavy = heavy_keys(same, "fp", coded.count(), "copies")
    out = spread_join(coded, named, "fp", heavy, ("id",), "left")
    component = F.when(F.col("id").isNotNull(), F.col("least")).alias("component_id")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)
