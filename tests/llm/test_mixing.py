"""The source mix: targets, draws, shards."""

import random
import re
from collections import Counter, defaultdict

import pytest
from cases import COLUMNS, documents
from pyspark.sql import functions as F

from lexmill.llm import mixing

WEIGHTS = [3, 1, 2]


def level_targets(sizes, weights, share, most):
    """Share by weight, cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: float(most * sizes[s]) for s in over}


def corpus(n=3000, seed=3):
    """One source holds a third of all rows; sizes vary a lot."""
    rng = random.Random(seed)
    source = lambda: rng.choice(["hot"] * 4 + ["a", "b", "c", "d", None, "Z", "é", "z"])
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 20, 60, 300])), source()) for i in range(n)]


def test_targets_level_off(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 7, "B": 400}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    for share, most in ((1.5, 2.0), (0.5, 2.0), (1.9, 2.0)):
        got = {r.source: r.target for r in mixing.targets(df, WEIGHTS, share, most).collect()}
        assert got == pytest.approx(level_targets(sizes, WEIGHTS, share, most))


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(docs, WEIGHTS).collect()
    assert len(got) == len(rows)
    of = {i: s for i, _, s in rows}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = level_targets(sizes, WEIGHTS, 1.5, 2.0)
    taken = Counter()
    for r in got:
        s = of[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken == r.size * len(r.draws) <= 2 * r.size
        assert len({d["pass"] for d in r.draws}) == len(r.draws)  # disjoint within a pass
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 150  # half of the longest row
    again = mixing.mix_plan(docs.repartition(7), WEIGHTS).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_shards_hold_like_shares(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    shards = Counter(d.shard for r in mixing.mix_plan(docs, WEIGHTS, depth=3).collect() for d in r.draws)
    assert set(shards) == set(range(8)) and max(shards.values()) < 2 * min(shards.values())


def test_splitting_tree_is_exact(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 31), (None, 1), ("z", 0)], "source string, drawn long")
    cut = mixing.splitting_tree(quotas, 3, 5).collect()
    per = Counter()
    spans = defaultdict(list)
    for r in cut:
        per[r.shard] += r.last - r["first"] + 1
        spans[r.source].append((r["first"], r.last))
    assert sum(per.values()) == 132 and max(per.values()) - min(per.values()) <= 1
    for source, n in (("a", 100), ("b", 31), (None, 1)):
        at = 0
        for lo, hi in sorted(spans[source]):
            assert lo == at
            at = hi + 1
        assert at == n


def test_split_is_hypergeometric(spark):
    """The mean and variance of a draw without replacement."""
    df = spark.range(2000).select(F.array(F.lit(10).cast("long"), F.lit(30).cast("long")).alias("c"), F.xxhash64("id").alias("s"))
    left = [r[0] for r in df.select(mixing._split(F.col("c"), F.lit(20), F.col("s"))[0]).collect()]
    mean, variance = sum(left) / len(left), sum((x - 5) ** 2 for x in left) / len(left)
    assert abs(mean - 5) < 0.15 and abs(variance - 20 * 0.25 * 0.75 * 20 / 39) < 0.25


def test_mixed_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(documents(), COLUMNS)
    plan = mixing.mix_plan(docs, WEIGHTS, keep=("doc_id", "score", "size"))
    assert plan.columns == ["doc_id", "score", "size", "source_size", "target", "taken", "draws"]
    mixed = mixing.mix(docs, WEIGHTS)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(len(r.draws) for r in mixing.mix_plan(docs, WEIGHTS).collect())
    empty = docs.limit(0)
    assert mixing.mix_plan(empty, WEIGHTS).count() == mixing.mix(empty, WEIGHTS).count() == 0


def test_a_source_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y", "b"), (3, "x y", "b")], "doc_id long, text string, source string")
    got = {(r.doc_id, r.size, r.source_size, r.target) for r in mixing.mix_plan(docs, WEIGHTS).collect()}
    assert got == {(1, 0, 0, 0.0), (2, 0, 0, 0.0), (3, 2, 4, 6.0)}
