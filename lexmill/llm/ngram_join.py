"""Jaccard self-join of documents on word n-grams, as components of linked documents.

Token-combination prefixes: the tokens (hashes of n-grams) of a set are put in one
global order, rarest first. Where two sets link, their first common token is rare and within a
prefix of both, or all their common tokens are of the frequent class and, within a
prefix extended for it, two of them stand next to each other in both sets: what only one
of the sets holds can part only so many neighbours. So rare tokens are indexed
singly, and frequent ones in combinations of two neighbours, as many as the prefix is long.
Candidates from the index are verified by exact intersection.

Steps: (1) equal sets become one class; (2) a first prefix in order of hash leaves out
classes that share too little of it with any other class; (3) document frequencies of
the remaining tokens, combined before their shuffle; (4) the index; (5) rounds over the
buckets of the index: some classes of a bucket, its hubs, are verified against those of other
components with which the places of the bucket's token allow a link, and leave the
bucket; each round has 64 times as many hubs in a bucket. The largest components of a
bucket have a centre each, which is verified against all of the bucket; classes linked to
it leave too, unless a class of another component is within twice the linking
distance: Jaccard distance is a metric, so what is near to the centre can't link with
what is farther away. So a group of near copies costs about one check a member, several
groups in one bucket some checks a member. A bucket whose classes are in one component is
settled; the rounds end with the last open one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, discard, heavy_keys, map_batches, measured, small, spread_join, store, struct, texts_of
from .components import connected_components

#: A token that more classes hold is of the frequent class and indexed in combinations.
FREQUENT = 16
#: Characters of several texts that are hashed at once.
SHINGLED = 1 << 19
#: Hubs of a bucket in a round, as a multiple of those in the round before; the first has one.
MORE_HUBS = 64
#: Components of a bucket that have a centre, and the classes that they hold there at least.
CENTRES, CENTRE_CLASSES = 4, 16
#: Tokens that are joined without a shuffle are fewer than this.
HOT = 1 << 16
#: Hubs, sets of hubs and labels are broadcast if they take so many bytes at most.
HUB_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))


def shingle_sets(texts: list[str], words: int, seed: int = 0) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct n-grams of ``words`` words.

    A-Z are lower-cased; words are runs of other bytes than space and \\x09-\\x0D. A text
    with fewer words is one n-gram, one without words has none. Texts are hashed some
    SHINGLED characters at a time, as each takes about 50 bytes meanwhile.
    """
    groups, size = [[]], 0
    for t in texts:
        if groups[-1] and size + len(t) > SHINGLED:
            groups.append([])
            size = 0
        groups[-1].append(t)
        size += len(t)
    return [s for g in groups for s in _shingled(g, words, seed)] if texts else []


def _shingled(texts: list[str], words: int, seed: int) -> list[np.ndarray]:
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    space = _SPACE[data]
    inner = ~space
    starts = np.flatnonzero(inner & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    ends = np.flatnonzero(space & np.concatenate([[False], inner[:-1]]))
    lengths = ends - starts
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    letters = data[inner]
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    offsets = np.arange(len(letters)) - np.repeat(firsts, lengths)
    word = _mix(np.add.reduceat(_BYTES[letters] * powers[offsets], firsts) + np.uint64(seed))
    rolled = word[: max(0, len(word) - words + 1)].copy()
    for i in range(1, words):
        rolled = _mix(rolled) + word[i : i + len(rolled)] * np.uint64(2 * i + 1)
    rolled = _mix(rolled)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.searchsorted(starts, begins)
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        count = hi - lo
        if count >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif count:
            acc = np.uint64(count)
            for w in word[lo:hi]:
                acc = _mix(np.array([acc ^ w], np.uint64))[0]
            out.append(np.array([acc], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least num / den."""

    num: int
    den: int

    def overlap(self, n):
        """The least number of tokens that a set of n shares with any set it links with."""
        return -(-n * self.num // self.den)

    def slack(self, n):
        return n - self.overlap(n)

    def extra(self, n):
        """Tokens by which the first prefix is longer than the slack: so many of it are shared."""
        return max(1, min(self.slack(n), self.overlap(n)))

    def differing(self, n):
        """The most tokens that only one of two linked sets holds, one of them of n tokens."""
        union = n * self.den // self.num
        return union - self.overlap(union)

    @cached_property
    def short(self) -> int:
        """Sets of fewer tokens may link without two common tokens that are neighbours in both."""
        sure = 2 * self.den // (2 * self.num - self.den) + 1
        return 1 + max((u for u in range(1, sure + 1) if 2 * self.overlap(u) < u + 2), default=0)

    @property
    def twice(self) -> Threshold:
        """The similarity at twice the distance of this one."""
        return Threshold(2 * self.num - self.den, self.den)

    def overlap_sql(self, n: str) -> str:
        return f"(({n} * {self.num} + {self.den - 1}) div {self.den})"

    def alone(self, n):
        """Whether a set of n links only with equal sets."""
        return (self.slack(n) == 0) & (n * self.den // self.num == n)

    def holds(self, shared: Column, a: Column, b: Column) -> Column:
        return shared * self.den >= (a + b - shared) * self.num

    def reachable(self, shared: Column, a: Column, b: Column) -> Column:
        """Whether sets of a and b tokens can link if they share at most ``shared``."""
        return self.holds(F.least(shared, a, b), a, b)


def signatures(tokens: np.ndarray, counts: np.ndarray, n: int, limit: Threshold, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of a set of n: hashes, the place in the order of each one's first token, frequent tokens before it.

    ``tokens`` are those that other sets hold too, ascending by (count, token); the
    n - len(tokens) unshared ones stand before them. At most slack tokens are not common, so
    the first common one is among the first slack + 1. If it is rare it is indexed. If not, no
    rare token is common, and of the common ones in order c1, c2, ... the first two with
    nothing between them in either set are at most as many gaps on as tokens differ:
    in this set the second of them stands at or before slack + differing - rare ones + 1.
    """
    slack, unshared = limit.slack(n), n - len(tokens)
    if unshared > slack or limit.alone(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    first = slack + 1 - unshared
    n_rare = int(np.searchsorted(counts, frequent, side="right"))
    alone = first if n < limit.short else min(n_rare, first)
    ahead = unshared + n_rare
    chain = tokens[n_rare : n_rare + max(0, slack + limit.differing(n) - 2 * ahead + 2)].view(np.uint64) if ahead <= slack else tokens[:0].view(np.uint64)
    pairs = _mix(chain[:-1] * np.uint64(3) + _mix(chain[1:])).view(np.int64)
    steps = np.arange(len(pairs), dtype=np.int32)
    singles = tokens[:alone]
    return np.concatenate([singles, pairs]), np.concatenate([unshared + np.arange(len(singles), dtype=np.int32), ahead + steps]), np.concatenate([np.zeros(len(singles), np.int32), steps])


def _name(tokens: np.ndarray) -> int | None:
    return int(np.bitwise_xor.reduce(_mix(tokens + np.uint64(len(tokens)))).view(np.int64)) if len(tokens) else None


def _classes(docs: DataFrame, words: int, limit: Threshold, id_col: str, text_col: str, tag: Column) -> tuple[DataFrame, int]:
    """Stored rows (id, tag, n, k, twin, prefix) and the seed of their hashes.

    k names the set; twin is a second hash of it, and if one name has several, all are
    named again with another seed. prefix: the set's first tokens in order of hash.
    """
    rows = docs.select(F.col(id_col).alias("id"), tag.cast("long").alias("tag"), F.col(text_col).alias("text"))
    schema = struct(id=rows.schema["id"].dataType, tag="long", n="long", k="long", twin="long", prefix="array<long>")
    for seed in range(8):

        def run(batch, seed=seed):
            out: dict[str, list] = {c: [] for c in ("n", "k", "twin", "prefix")}
            for s in shingle_sets(texts_of(batch, "text"), words, seed):
                n = len(s)
                out["n"].append(n)
                out["k"].append(_name(s))
                out["twin"].append(int(np.add.reduce(_mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if n else None)
                out["prefix"].append([] if limit.alone(n) else s[: limit.slack(n) + limit.extra(n)].view(np.int64).tolist())
            yield arrow_batch(schema, out | {c: batch.column(c) for c in ("id", "tag")})

        got = store(map_batches(rows, run, schema), "join-classes")
        if not got.where("k is not null").groupBy("k").agg((F.min("twin") != F.max("twin")).alias("x")).where("x").limit(1).count():
            return got, seed
        discard(got)
    raise RuntimeError("set names keep clashing")


def _compared(pairs: DataFrame, sets: DataFrame, hubs: DataFrame, limit: Threshold) -> DataFrame:
    """Stored (a, b, linked) of those pairs of a hub a and a class b that are within twice the linking distance, by exact intersection."""
    n_hubs, tokens = hubs.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    left = sets.join(small(hubs.select("k"), n_hubs, 24, HUB_BYTES), "k", "left_semi").select(F.col("k").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("k").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = pairs.join(right, "b")
    if 8 * tokens + 64 * n_hubs <= HUB_BYTES:
        both = both.join(F.broadcast(left), "a")
    else:
        both = spread_join(both, left, "a", heavy_keys(pairs.groupBy("a").count(), "a", pairs.count()), ("b",))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    close = both.select("a", "b", "n_a", "n_b", shared.alias("shared")).where(limit.twice.holds(F.col("shared"), F.col("n_a"), F.col("n_b")))
    return store(close.select("a", "b", limit.holds(F.col("shared"), F.col("n_a"), F.col("n_b")).alias("linked")), "join-compared")


def _possible(limit: Threshold) -> Column:
    """Of two entries of a bucket: can their sets link if this is the first entry that they share?

    Common tokens before a combination are frequent, and each of them is parted from the next
    by a token of one set only: at most a third of the frequent tokens before it in both.
    """
    rest = F.least(F.col("n") - F.col("place"), F.col("h_n") - F.col("h_place"))
    missed = F.least(F.col("before"), F.col("h_before"), F.expr("(before + h_before) div 3"))
    return limit.reachable(rest + missed, F.col("n"), F.col("h_n"))


def link(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, tag: Column | None = None) -> DataFrame:
    """(id, n_shingles, component_id[, tag]) of every row of ``docs``.

    Documents link where the Jaccard similarity of their sets of ``words``-word shingles
    is at least num / den; component_id is the smallest id that links lead to, the
    row's own included. No link between different texts is lost: similarity is checked
    on 64-bit hashes of the shingles, candidates come from an index that misses none.
    A null or empty text, or one without words, has an empty set and no links; fewer
    words than a shingle make one shingle of all. Equal sets link (repeated rows
    too). A null id takes no part in links: its component_id is null. ``tag`` is passed
    through as a long, to tell rows of one id apart. Other columns aren't read; an
    empty table gives no rows.
    """
    if 2 * num <= den or num > den:
        raise ValueError("the similarity must be over 1/2 and at most 1")
    limit = Threshold(num, den)
    slim, seed = _classes(docs, words, limit, id_col, text_col, F.lit(None) if tag is None else tag)
    linked = slim.where("id is not null and n > 0")
    classes = store(linked.groupBy("k").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "join-sets")
    # a set that very many documents hold is dealt over several tasks
    heavy = heavy_keys(classes, "k", slim.count(), "copies")
    copies = spread_join(linked.select("id", "k"), classes.where("copies > 1").select("k", "rep"), "k", heavy, ("id",)).where("id <> rep").select("id", "k")
    copies = store(copies, "join-copies")
    first = linked.join(measured(copies), ["id", "k"], "left_anti")

    # (2) classes that share enough of their first prefix with other classes
    # (by id, which is shorter to shuffle; an id with several texts has the hits of all of them)
    postings = first.select("id", F.explode("prefix").alias("t"))
    common = store(postings.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "join-common")
    hits = _counted(postings, common).groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    overlap = F.expr(limit.overlap_sql("n"))
    extra = F.greatest(F.lit(1), F.least(F.col("n") - overlap, overlap))
    kept = store(hits.join(classes.withColumnRenamed("rep", "id"), "id").where(F.col("hits") >= extra).select("k", "id"), "join-kept")
    n_kept = kept.count()
    discard(copies)
    discard(common)
    label = None
    if n_kept:
        sets = _shared_tokens(docs, kept, n_kept, words, seed, limit, id_col, text_col)
        label = _components(_index(sets, limit, frequent), sets, limit)
    if label is None:
        named = classes.select("k", F.col("rep").alias("component"))
    else:
        # a component is named by one of its sets; the smallest id is what counts
        whole = classes.join(label, "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component")
        names = whole.groupBy("c").agg(F.min("rep").alias("component"))
        named = whole.join(names, "c").select("k", "component")
    out = spread_join(slim.select("id", "tag", "n", "k"), named, "k", heavy, ("id", "tag"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component, *([] if tag is None else ["tag"]))


def _shared_tokens(docs: DataFrame, kept: DataFrame, n_kept: int, words: int, seed: int, limit: Threshold, id_col: str, text_col: str) -> DataFrame:
    """(3) Stored (k, n, tokens, counts) of the kept classes: the tokens that another kept class holds, and in how many."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(measured(kept), "id").select("k", "text")
    schema = struct(k="long", n="long", tokens="array<long>")

    def run(batch):
        out: dict[str, list] = {"k": [], "n": [], "tokens": []}
        for k, s in zip(batch.column("k").to_pylist(), shingle_sets(texts_of(batch, "text"), words, seed)):
            if _name(s) == k:  # an id may stand for several texts
                out["k"].append(k)
                out["n"].append(len(s))
                out["tokens"].append(s.view(np.int64).tolist())
        yield arrow_batch(schema, out)

    number = F.monotonically_increasing_id()  # written with the rows; shorter to shuffle than k
    full = store(map_batches(rows, run, schema).withColumn("c", number), "join-tokens")
    if full.count() != n_kept:  # repeated rows
        once = store(full.drop("c").dropDuplicates(["k"]).withColumn("c", number), "join-tokens")
        discard(full)
        full = once
    flat = full.select("c", F.explode("tokens").alias("t"))
    counts = store(flat.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "join-counts")
    shared = _counted(flat, counts).groupBy("c").agg(F.array_sort(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "t"))).alias("x"))
    sets = shared.join(full.select("c", "k", "n"), "c").where(F.size("x") >= F.expr(limit.overlap_sql("n")))
    out = store(sets.select("k", "n", F.col("x.t").alias("tokens"), F.col("x.df").alias("counts")), "join-shared")
    discard(full)
    discard(counts)
    return out


def _counted(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with the df of their token t, from stored ``counts``; rows of other tokens go.

    Fewer than HOT tokens have over 1 / HOT of all rows each: they are sent to all tasks and
    met without a shuffle, so that of what is left no token has many rows.
    """
    total = counts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    often = F.col("df") * HOT > total
    hot = F.broadcast(counts.where(often))
    rest = rows.join(hot.select("t"), "t", "left_anti").join(counts.where(~often), "t")
    return rows.join(hot, "t").unionByName(rest)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as arrays."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])


def _index(sets: DataFrame, limit: Threshold, frequent: int) -> DataFrame:
    """(4) Stored index entries (s, k, n, place, before, rare)."""
    schema = struct(k="long", n="long", rare="long", hashes="array<long>", places="array<int>", befores="array<int>")

    def run(batch):
        sizes = batch.column("n").to_pylist()
        found = [(n - len(t), *signatures(t, c, n, limit, frequent)) for n, t, c in zip(sizes, _arrays(batch.column("tokens")), _arrays(batch.column("counts")))]
        columns = zip(*found) if found else [[]] * 4
        yield arrow_batch(schema, {"k": batch.column("k"), "n": batch.column("n")} | dict(zip(("rare", "hashes", "places", "befores"), map(list, columns))))

    flat = map_batches(sets, run, schema).select("k", "n", "rare", F.explode(F.arrays_zip("hashes", "places", "befores")).alias("x"))
    return store(flat.select(F.col("x.hashes").alias("s"), "k", "n", F.col("x.places").alias("place"), F.col("x.befores").alias("before"), "rare"), "join-index")


def _met(work: DataFrame, hubs: DataFrame) -> DataFrame:
    """Entries beside the hubs of their bucket."""
    n_hubs = hubs.count()
    if n_hubs * 72 <= HUB_BYTES:
        return work.join(F.broadcast(hubs), "s")
    return spread_join(work, hubs, "s", heavy_keys(work.groupBy("s").count(), "s", work.count()), ("k",))


def _in_components(pairs: DataFrame, label: DataFrame, n_label: int) -> DataFrame:
    """Pairs (a, b) with the components c_a and c_b of both; a class that links with none is its own."""
    for x, y in ("ab", "ba"):
        of = label.select(F.col("k").alias(x), F.col("component").alias("c"))
        if n_label * 24 <= HUB_BYTES:
            pairs = pairs.join(F.broadcast(of), x, "left")
        else:  # a hub has very many pairs
            pairs = spread_join(pairs, of, x, heavy_keys(pairs.groupBy(x).count(), x, pairs.count()), (y,), "left")
        pairs = pairs.withColumn(f"c_{x}", F.coalesce("c", x)).drop("c")
    return pairs


def _joined(label: DataFrame | None, n_label: int, links: DataFrame) -> DataFrame | None:
    """Stored (k, component) after more links between classes: only components that a link joins are merged."""
    if label is None:
        if not links.take(1):
            return None
        return store(connected_components(links).select(F.col("node").alias("k"), "component"), "join-labels")
    new = store(_in_components(links, label, n_label).where("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "join-merged")
    if not new.take(1):
        return label
    merged = store(connected_components(new), "join-merged")
    n_merged = merged.count()
    moved = label.join(small(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), n_merged, 24, HUB_BYTES), "component", "left")
    first = merged.select(F.col("node").alias("k"), "component").join(small(label.select("k"), n_label, 16, HUB_BYTES), "k", "left_anti")
    return store(moved.select("k", F.coalesce("to", "component").alias("component")).unionByName(first), "join-labels")


def _components(entries: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame | None:
    """(5) Stored (k, component) of the sets that link with another; None where none does."""
    label, n_label, rest, each = None, 0, entries, 1
    as_hub = [F.col(c).alias(f"h_{c}") for c in ("k", "n", "place", "before", "c")]
    while True:
        now = rest.withColumn("c", F.col("k"))
        if label is not None:
            now = rest.join(small(label, n_label, 24, HUB_BYTES), "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component")
        # per component of a bucket its size and its class with the fewest unshared tokens
        least = F.min(F.struct("rare", F.xxhash64("k").alias("x"), "k", "n", "place", "before", "c")).alias("h")
        per = now.groupBy("s", "c").agg(F.count(F.lit(1)).alias("size"), least)
        several = per.groupBy("s").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "c")).alias("most"), F.min("h").alias("h")).where("parts > 1")
        open_ = store(several.select("s", "all", F.col("most.c").alias("main"), "h"), "join-open")
        n_open = open_.count()
        if not n_open:
            return label
        side = open_.select("s", "all", "main")
        if n_open * 40 <= HUB_BYTES:
            work = now.join(F.broadcast(side), "s")
        else:
            work = spread_join(now, side, "s", heavy_keys(open_, "s", rest.count(), "all"), ("k",))
        work = store(work, "join-work")
        if each == 1:
            hubs = open_.select("s", "h.*").select("s", *as_hub)
        else:  # of the classes outside the largest component about so many, by a hash of the class
            turn = F.shiftrightunsigned(F.xxhash64(F.lit(3), "k"), 11) / F.lit(float(1 << 53))
            hubs = work.where((F.col("c") != F.col("main")) & (turn * F.col("all") < each)).select("s", *as_hub)
        hubs = store(hubs, "join-hubs")
        pairs = _met(work, hubs).where((F.col("c") != F.col("h_c")) & _possible(limit)).select(F.col("h_k").alias("a"), F.col("k").alias("b"))
        centres = None
        if each > 1:
            order = Window.partitionBy("s").orderBy(F.col("size").desc(), "h")
            large = per.where(F.col("size") >= CENTRE_CLASSES).join(small(open_.select("s"), n_open, 24, HUB_BYTES), "s", "left_semi")
            centres = store(large.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= CENTRES).select("s", "h.*").select("s", *as_hub), "join-centres")
            if not centres.take(1):
                centres = None
        known = hubs.select(F.col("h_k").alias("k"), F.col("h_n").alias("n"))
        if centres is not None:
            around = _met(work, centres).where((F.col("k") != F.col("h_k")) & limit.twice.reachable(F.least("n", "h_n"), F.col("n"), F.col("h_n"))).select("s", F.col("h_k").alias("a"), F.col("k").alias("b"))
            pairs = pairs.unionByName(around.select("a", "b"))
            known = known.unionByName(centres.select(F.col("h_k").alias("k"), F.col("h_n").alias("n")))
        pairs = store(pairs.distinct(), "join-pairs")
        checked = _compared(pairs, sets, known.distinct(), limit)
        discard(pairs)
        found = checked.where("linked").select("a", "b")
        label = _joined(label, n_label, found)
        n_label = 0 if label is None else label.count()
        gone = hubs.select("s", F.col("h_k").alias("k"))
        if centres is not None:
            n_centres = centres.count()
            middle = small(centres.select(F.col("h_k").alias("a")).distinct(), n_centres, 24, HUB_BYTES)
            seen = _in_components(checked.join(middle, "a", "left_semi"), label, n_label)
            ringed = seen.where("c_a <> c_b").select("a").distinct()
            near = seen.where("linked").select("a", "b").join(small(ringed, n_centres, 24, HUB_BYTES), "a", "left_anti")
            gone = gone.unionByName(centres.select("s", F.col("h_k").alias("k"))).unionByName(around.join(near, ["a", "b"]).select("s", F.col("b").alias("k"))).distinct()
        left = store(work.join(gone, ["s", "k"], "left_anti").select(*entries.columns), "join-rest")
        for done in (rest, work, hubs, open_, centres):
            if done is not None:
                discard(done)
        rest, each = left, each * MORE_HUBS
