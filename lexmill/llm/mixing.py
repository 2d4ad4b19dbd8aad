"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's rows fall into blocks by a pseudo-random permutation of the rows, so a
block is a random subset of its source. In each pass over a source its blocks stand in a
permuted order of their own; a source's quota is the number of blocks, from the front of
that order, that its target takes: all of each full pass, and so many of the last. The quotas
are split recursively among the output shards, each split an exact
multivariate-hypergeometric draw, so every shard holds a random share of every source. A
shard takes as many of the next blocks of each source as its quota says: those drawn blocks
are what the mix takes, disjoint within a pass. Rows of a shard are put in random order
there. Everything is DataFrame expressions; all draws are hashes of a seed, so reruns agree.

A source has at most MOST_BLOCKS blocks, which grow with it, so that the tables by block, the
arrays that a tree node walks and the windows over a source's blocks stay bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, store

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; blocks of a source at least and at most (larger sources have larger blocks).
BLOCK_WORDS = 65_536
LEAST_BLOCKS, MOST_BLOCKS = 32, 16_384


def words_of(text: Column) -> Column:
    """Words of a text, null as 0: starts of runs that are not white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*keys: Column | str) -> Column:
    """A hash of the keys as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Rows (source, source_size) plus weight and target.

    Sources in code point order, null last, take the weights in turn. Together they
    get ``share`` of all sizes by weight; a target stops at ``most`` times its source's
    size and the excess is shared again by weight: target = min(cap, level * weight) for
    the one level that uses everything up (all targets are caps if ``share >= most``).
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row per source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    capped = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = capped.withColumn("level", level)
    return leveled.withColumn("target", F.least("cap", F.max("level").over(everyone) * F.col("weight"))).select("source", "source_size", "weight", "target")


def _split(counts: Column, half: Column, seed: Column) -> Column:
    """How many of each source's blocks go left: a multivariate-hypergeometric draw of ``half`` blocks.

    Selection sampling: block after block goes left with the chance of places left over
    blocks left, which is exactly a draw without replacement.
    """
    state = F.struct(F.lit(0).cast("long").alias("source"), F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).alias("blocks"), half.cast("long").alias("places"), F.expr("cast(array() as array<bigint>)").alias("taken"))

    def source(acc: Column, count: Column) -> Column:
        start = F.struct(acc.blocks.alias("blocks"), acc.places.alias("places"), F.lit(0).cast("long").alias("left"))

        def block(a: Column, i: Column) -> Column:
            goes = (unit(seed, acc.source, i) * a.blocks < a.places).cast("long")
            return F.struct((a.blocks - 1).alias("blocks"), (a.places - goes).alias("places"), (a.left + goes).alias("left"))

        steps = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.expr("cast(array() as array<bigint>)"))
        end = F.aggregate(steps, start, block)
        return F.struct((acc.source + 1).alias("source"), end.blocks.alias("blocks"), end.places.alias("places"), F.concat(acc.taken, F.array(end.left)).alias("taken"))

    return F.aggregate(counts, state, source, lambda a: a.taken)


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source, shard, first, last): the stretch of each source's drawn blocks, from 0, that a shard takes.

    ``quotas`` has (source, drawn). There are 2**depth shards; blocks are divided
    evenly among them, in number. One row per tree node holds the counts of all sources.
    """
    root = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "drawn"))).alias("s"))
    node = root.where(F.size("s") > 0).select(F.col("s.source").alias("sources"), F.col("s.drawn").alias("counts"), F.lit(0).cast("long").alias("shard"))
    for level in range(depth):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        draw = _split(F.col("counts"), F.floor(total / 2), F.xxhash64(F.lit(seed), F.lit(level), "shard"))
        halves = node.withColumn("left", draw).withColumn("right", F.zip_with("counts", "left", lambda a, b: a - b))
        node = store(halves.select("sources", F.posexplode(F.array("left", "right")).alias("side", "counts"), (F.col("shard") * 2).alias("even")).select("sources", "counts", (F.col("even") + F.col("side")).alias("shard")), "mix-tree")
    leaf = node.select("shard", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("shard", F.col("x.sources").alias("source"), F.col("x.counts").alias("n")).where("n > 0")
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("shard"))
    return leaf.select("source", "shard", (upto - F.col("n")).alias("first"), (upto - 1).alias("last"))


def plan(rows: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, depth: int = 4, seed: int = 7) -> DataFrame:
    """The mix of ``rows`` (source, size, key): the rows plus source_size, target and draws.

    ``key`` identifies a row to the permutation (equal keys of a source go together
    into one block); ``draws`` is an array of struct(pass, shard), one per time the mix takes the
    row. A row is taken as often as its block is drawn: in each full pass that its
    source's target holds, and in a last pass up to the block in which the target is reached;
    of that block rows are taken, in permuted order, up to the row whose middle passes
    it. So a source's words are within half a row of its target (equal keys count as one
    row), and no row is taken more than ceil(most) times.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    aimed = targets(sizes, weights, share, most).withColumns({
        "blocks": F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("long"),
        "full": F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long"),
    }).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    aimed = store(aimed, "mix-targets")
    n_sources, longest = aimed.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("source")), F.lit(0))).first()

    def bounded(df: DataFrame, count: int) -> DataFrame:
        return F.broadcast(df) if count * (128 + longest) <= BROADCAST_BYTES else df

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    side = bounded(aimed.withColumnRenamed("source", "t_source"), n_sources)
    placed = rows.join(side, same("source", "t_source")).drop("t_source", "weight").withColumns({
        "at": unit(F.lit(seed), "source", "key"),
    }).withColumn("block", F.floor(F.col("at") * F.col("blocks")))

    # each pass's blocks in its permuted order, up to the one in which the target is reached
    words = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("full").alias("full"), F.first("rest").alias("rest"))
    turns = words.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full")))).withColumn("turn", F.xxhash64(F.lit(seed + 1), "source", "pass", "block"))
    upto = F.sum("words").over(Window.partitionBy("source", "pass").orderBy("turn", "block"))
    queue = turns.withColumn("before", upto - F.col("words")).where((F.col("pass") < F.col("full")) | (F.col("before") < F.col("rest")))
    place = F.row_number().over(Window.partitionBy("source").orderBy("pass", "turn", "block")) - 1
    last = F.lead("block").over(Window.partitionBy("source", "pass").orderBy("turn", "block")).isNull() & (F.col("pass") == F.col("full"))
    queue = store(queue.withColumns({"place": place, "last": last}).select("source", "pass", "block", "before", "place", "last"), "mix-queue")
    n_drawn = queue.count()

    # within a source's last block only: rows in permuted order
    edge = bounded(queue.where("last").select(F.col("source").alias("e_source"), F.col("block").alias("edge"), "before"), n_sources)
    inside = placed.join(edge, same("source", "e_source") & (F.col("block") == F.col("edge"))).groupBy("source", "at").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("at"))
    stops = inside.withColumn("middle", F.col("before") + run - F.col("words") / 2).where("middle <= rest").groupBy("source").agg(F.max("at").alias("stop"))
    stops = store(stops, "mix-stops").select(F.col("source").alias("s_source"), "stop")

    # quotas, split among the shards; a shard takes the next blocks of each source's order
    shares = splitting_tree(queue.groupBy("source").agg(F.count(F.lit(1)).alias("drawn")), depth, seed)
    dealt = queue.alias("a").join(shares.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & F.col("a.place").between(F.col("b.first"), F.col("b.last"))).select("a.source", "a.block", "a.pass", "a.last", "b.shard")
    dealt = dealt.join(bounded(stops, n_sources), same("source", "s_source"), "left").withColumn("stop", F.when(F.col("last"), F.coalesce("stop", F.lit(-1.0))).otherwise(F.lit(1.0)))
    homes = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "stop"))).alias("homes"))
    homes = bounded(store(homes, "mix-blocks").select(F.col("source").alias("h_source"), F.col("block").alias("h_block"), "homes"), n_drawn)
    taken = placed.join(homes, same("source", "h_source") & (F.col("block") == F.col("h_block")), "left")
    none = F.expr("cast(array() as array<struct<pass:bigint,shard:bigint,stop:double>>)")
    draws = F.transform(F.filter(F.coalesce("homes", none), lambda h: F.col("at") <= h["stop"]), lambda h: F.struct(h["pass"].alias("pass"), h["shard"].alias("shard")))
    return taken.withColumn("draws", draws).drop("blocks", "full", "rest", "at", "block", "homes", "h_source", "h_block")


def _keyed(docs: DataFrame, source_col: str, text_col: str, key_cols: tuple[str, ...]) -> DataFrame:
    """A table of only what the plan needs; the row's own columns under ``doc``."""
    key = F.xxhash64(*[F.col(c) for c in key_cols], F.col(text_col))
    return docs.select(F.col(source_col).cast("string").alias("source"), words_of(F.col(text_col)).alias("size"), key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))


def mix_plan(docs: DataFrame, weights: list[float], keep: tuple[str, ...] = ("doc_id",), source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``keep`` columns, size, source_size, target, taken and draws of every row of ``docs``.

    Sizes are words (null text: 0). taken is size times the number of draws. Rows with
    a null source form a source of their own, the last; a source without words has
    target 0 and gives nothing; rows of size 0 may be drawn with their block;
    repeated rows share their fate; ties of the permutation are taken or left together; a column of ``keep`` named like an output is
    replaced by it; an empty table gives no rows.
    """
    kept = [c for c in keep if c not in ("size", "source_size", "target", "taken", "draws")]
    slim = store(_keyed(docs, source_col, text_col, tuple(keep)).select("source", "size", "key", F.struct(*[F.col(f"doc.{c}").alias(c) for c in kept]).alias("doc")), "mix-sizes")
    out = plan(slim, weights, **options)
    return out.select(*[F.col(f"doc.{c}").alias(c) for c in kept], "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws")


def mix(docs: DataFrame, weights: list[float], source_col: str = "source", text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",), depth: int = 4, seed: int = 7, **options) -> DataFrame:
    """The mixed rows themselves: the columns of ``docs``, a row as often as the mix takes it.

    Rows are dealt out by shard, each shard in a random order of its own. Null and empty texts
    have size 0 and come with their block; a null source is a source, the last; repeated rows share
    their fate; other columns of any name are kept as they are, long texts whole; an empty
    table gives no rows.
    """
    out = plan(_keyed(docs, source_col, text_col, key_cols), weights, depth=depth, seed=seed, **options)
    drawn = out.select("doc", "key", F.explode("draws").alias("d")).select("doc", F.col("d.shard").alias("shard"), F.xxhash64(F.lit(seed + 2), "key", "d.pass", "d.shard").alias("turn"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(1, math.ceil(parts / (1 << depth)))  # a shard is dealt over several tasks by its random order
    spread = drawn.withColumn("piece", F.pmod(F.col("turn"), F.lit(pieces)))
    return spread.repartition(parts, "shard", "piece").sortWithinPartitions("shard", "turn").select("doc.*")
