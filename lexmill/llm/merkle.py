"""Merkle manifest of a dataset, built level by level within blocks by higher-order functions.

Each row is a leaf; the leaves of a group stand in order. A block is an array of a fixed number
of consecutive leaves; sequence, transform and slice make each level of it from the one
below, aggregate runs through the levels. The roots of the blocks are the nodes of the next
round, until each group has one, and the groups' roots make one more such tree. What a leaf
needs to be checked, its path, is read off the levels of its block and followed by the
path of the block itself.

A group of any size is dealt over tasks by ranges of the order; a task holds one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, heavy_keys, spread_join, store
from .ordering import numbered

#: Levels of a block: it has fan ** DEPTH leaves.
FAN, DEPTH = 2, 10


def digest(text: Column) -> Column:
    """SHA-256 as lower-case hex."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf holds it: ``-`` for null, else its length in bytes of UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _run(nodes: Column, first: Column, count: Column | int) -> Column:
    """Some nodes' digests as one text; ``first`` is from 0."""
    return F.array_join(F.slice(nodes, first + 1, F.lit(count) if isinstance(count, int) else count), "")


def _whole(x: Column) -> Column:
    return F.floor(x).cast("int")


def _levels(nodes: Column, steps: Column, fan: int, depth: int) -> Column:
    """The nodes and ``steps`` levels above them, each a run of ``fan`` nodes hashed; the last run may be shorter."""
    above = lambda last: F.transform(F.sequence(F.lit(0), _whole((F.size(last) - 1) / fan)), lambda i: digest(_run(last, i * fan, fan)))
    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(depth)), 1, steps), F.array(nodes), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _path(levels: Column, at: Column, steps: Column, fan: int, depth: int) -> Column:
    """What stands left and right of a leaf's ancestors in their runs, level by level from the leaf up."""

    def beside(level: Column) -> Column:
        nodes = F.element_at(levels, level + 1)
        mine = _whole(at / F.pow(F.lit(fan), level))
        first = _whole(mine / fan) * fan
        return F.struct(_run(nodes, first, mine - first).alias("left"), _run(nodes, mine + 1, first + fan - mine - 1).alias("right"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(depth - 1)), 1, steps), beside)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, start, lambda node, x: digest(F.concat(x["left"], node, x["right"])))


def proof(path: Column) -> Column:
    """The siblings on a path as one text, left to right and from the leaf up."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def _blocks(nodes: DataFrame, fan: int, depth: int, keep: list[str]) -> DataFrame:
    """Stored (g, b, n, top, items) by blocks of nodes (g, place, n, node): items have their path in the block, and ``keep``."""
    size = fan**depth
    placed = nodes.withColumn("b", F.floor(F.col("place") / size))
    listed = placed.groupBy("g", "b").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "node", *keep))).alias("x"))
    # a group of one block ends as soon as one node is left; others have all levels of a block
    steps = F.size(F.filter(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.pow(F.lit(fan), i) < F.col("n")))
    built = listed.withColumn("steps", steps).withColumn("levels", _levels(F.col("x.node"), F.col("steps"), fan, depth))
    item = lambda i: F.struct(i["place"].alias("place"), i["node"].alias("node"), *[i[k].alias(k) for k in keep], _path(F.col("levels"), (i["place"] - F.col("b") * size).cast("int"), F.col("steps"), fan, depth).alias("path"))
    return store(built.select("g", "b", "n", F.element_at(F.element_at("levels", -1), 1).alias("top"), F.transform("x", item).alias("items")), "merkle-blocks")


def _tree(nodes: DataFrame, fan: int, depth: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(g, root) of each group, and the rows (g, place, node, keep, path) of its nodes, paths up to the root."""
    size = fan**depth
    rounds = [_blocks(nodes, fan, depth, keep)]
    while (several := rounds[-1].where(F.col("n") > size)).take(1):
        above = several.select("g", F.col("b").alias("place"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"))
        rounds.append(_blocks(above, fan, depth, []))
    roots = None
    for blocks in rounds:
        done = blocks.where(F.col("n") <= size).select("g", F.col("top").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
    path = None
    for i, blocks in reversed(list(enumerate(rounds))):
        kept = keep if i == 0 else []
        rows = blocks.select("g", "b", "items") if path is None else blocks.select("g", "b", "items").join(path, ["g", "b"], "left")
        rest = F.array().cast("array<struct<left:string,right:string>>") if path is None else F.coalesce("rest", F.array().cast("array<struct<left:string,right:string>>"))
        rows = rows.withColumn("__rest", rest).select("g", "__rest", F.explode("items").alias("i"))
        whole = rows.select("g", F.col("i.place").alias("place"), F.col("i.node").alias("node"), *[F.col(f"i.{k}").alias(k) for k in kept], F.concat("i.path", "__rest").alias("path"))
        path = whole.select("g", F.col("place").alias("b"), F.col("path").alias("rest"))
    return roots, whole


def manifest(docs: DataFrame, leaf_of: Column, group_col: str = "lang", id_col: str = "doc_id", keep: dict[str, Column] | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(id, leaf, subroot, root, path) of every row, and the columns ``keep``.

    ``leaf_of`` is a row's digest (see ``leaf``). The leaves of each value of the group column
    ascend by id, null first, and equal ids by their digest; while several nodes are left,
    runs of ``fan`` become the digest of their digests, the last run of fewer too. The last
    one, or a lone leaf itself, is the group's subroot; subroots by group, null first and by
    bytes of UTF-8, make the root likewise. path leads from leaf to root. A null, empty
    or very long value is a leaf like any other; repeated rows are leaves of their own; other columns
    aren't read, whatever their names; no rows give no rows.
    """
    kept = keep or {}
    # a text in whose order nulls are first
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g")
    inner = docs.select(group, F.col(id_col).alias("id"), leaf_of.alias("node"), *[v.alias(f"kept_{k}") for k, v in kept.items()])
    names = [f"kept_{k}" for k in kept]
    made = store(inner, "merkle-leaves")
    leaves = numbered(made, [F.col("g"), F.col("id").asc_nulls_first(), F.col("node")], by="g", name="merkle-ordered")
    roots, rows = _tree(leaves, fan, depth, ["id", *names])
    tops = numbered(roots.select("g", F.col("root").alias("node")), [F.col("g")], name="merkle-groups")
    top, above = _tree(tops.withColumnRenamed("g", "of").withColumn("g", F.lit("")), fan, depth, ["of"])
    found = top.select("root").first()
    discard(made)
    upper = above.select(F.col("of").alias("g"), F.col("node").alias("subroot"), F.col("path").alias("upper"))
    size = upper.agg(F.coalesce(F.sum(F.octet_length("g") + 128 + F.size("upper") * (64 * fan)), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(upper), "g")
    else:
        counts = leaves.groupBy("g").count()
        joined = spread_join(rows, upper, "g", heavy_keys(counts, "g", leaves.count()), ("id", "node"))
    root = F.lit(found["root"] if found else None).cast("string").alias("root")
    out = [F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", root, F.concat("path", "upper").alias("path")]
    return joined.select(*out, *[F.col(f"kept_{k}").alias(k) for k in kept])
