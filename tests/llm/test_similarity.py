"""Vector search, fingerprints and the n-gram join against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from cases import COLUMNS, documents

from lexmill.llm import common, ngram_join, vector_search, winnowing


# vectors
def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    centre, turn = x.mean(0), vector_search.rotation(64, 3)
    assert np.allclose(turn @ turn.T, np.eye(64))
    guess, error = vector_search.estimate(*vector_search.encode(x, centre, turn), q, centre, turn)
    off = np.abs(guess - q @ x.T) / error
    assert (off <= 3).mean() > 0.99 and 0.5 < np.sqrt((off**2).mean()) < 1.5


@pytest.mark.parametrize("blocks,bound", [((16_384, 4_096, 16_384), 2.0), ((100, 7, 16_384), 2.0), ((100, 7, 100), 2.0), ((100, 7, 100), None)])
def test_search_against_brute_force(spark, blocks, bound):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 24)) * rng.uniform(0.2, 3, size=(700, 1))
    x[300:520] = x[299]  # a third of all rows is one vector
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    bad = [(1000, None, "n"), (1020, [0.0] * 24, "z"), (1040, [math.nan] + [1.0] * 23, "x"), (1060, [math.inf] + [1.0] * 23, "x"), (1080, [1.0] * 23 + [None], "x"), (1100, [1.0], "x"), (None, [1.0] * 24, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank string")
    got = vector_search.search(df, df.where("vec_id % 20 = 0"), k=20, bound=bound, block_rows=blocks[0], block_queries=blocks[1], first_rows=blocks[2]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == list(range(0, 700, 20))
    hits = 0
    for q, found in by.items():
        score = (x * x[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(700), -score)) if i != q][:20]
        found.sort()
        assert [n for n, _, _ in found] == list(range(1, 21))
        assert [v for _, v, _ in found] == [v for _, v, _ in sorted(found, key=lambda f: (-f[2], f[1]))]
        assert all(s == pytest.approx(score[v], rel=1e-12) and v != q for _, v, s in found)
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / (20 * len(by)) >= (1 if bound is None else 0.97)


def test_few_rows_meet_their_vectors(spark, monkeypatch):
    """Beyond the first pass, on vectors that nothing groups: recall, and the rows that are scored."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 64)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    kept, real = {}, vector_search.store

    def counted(table, name):
        out = real(table, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(vector_search, "store", counted)
    monkeypatch.setattr(vector_search, "FIRST_SHARE", 1 / 16)
    queries = list(range(0, len(x), 200))
    got = vector_search.search(df, df.where("vec_id % 200 = 0"), first_rows=1).toPandas()
    x = x.astype(np.float64)
    hits = 0
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine.score, score[mine.vec_id], rtol=1e-9)
        hits += len(set(np.argpartition(-score, 20)[:20]) & set(mine.vec_id))
    assert hits / (20 * len(queries)) >= 0.95
    met = kept["vector-likely"] + kept["vector-rest"]
    assert met < 0.3 * kept["vector-hits"] and met / len(queries) < 0.025 * len(x), kept


def test_the_provided_vectors():
    """Recall and the share of rows that are scored, over a table of the size that the queries are timed on."""
    import duckdb

    file = Path("/root/testdata/sf0.1/embeddings.parquet")
    if not file.exists():
        pytest.skip("no table")
    rows = duckdb.sql(f"SELECT vec_id, embedding::DOUBLE[] FROM read_parquet('{file}') ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    centre, turn = x[:1000].mean(0), vector_search.rotation(x.shape[1], 11)
    asked = np.flatnonzero(ids % 20 == 0)
    hits = scored = 0
    for i, places, _, n in vector_search.nearest(ids, x, vector_search.encode(x, centre, turn), ids[asked], x[asked], centre, turn, 20, vector_search.BOUND):
        score = (x * x[asked[i]]).sum(1)
        best = [j for j in np.lexsort((ids, -score)) if j != asked[i]][:20]
        hits += len(set(best) & set(places.tolist()))
        scored += n
    assert hits / (20 * len(asked)) >= 0.99 and scored / (len(asked) * len(ids)) < 0.1


def test_later_blocks_hold_codes_alone(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 16)))], "vec_id long, embedding array<double>")
    plans, real = {}, vector_search.store

    def planned(table, name):
        plans[name] = table._jdf.queryExecution().executedPlan().toString()
        return real(table, name)

    monkeypatch.setattr(vector_search, "store", planned)
    vector_search.search(df, df.where("vec_id % 20 = 0"), first_rows=50)
    plan = plans["vector-hits"]
    assert plan[plan.index("FlatMapCoGroupsInArrow") :].splitlines()[0].count("v#") == 0


def test_search_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], schema)
    got = [tuple(r) for r in vector_search.search(df, df.where("vec_id = 0"), k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 1.0)]
    for rows in ([], [(0, None)], [(0, [0.0])]):
        few = spark.createDataFrame(rows, schema)
        assert vector_search.search(few, few).count() == 0


# fingerprints
def plain_fingerprint(text, k, w):
    if not text:
        return []
    k, mask, out = min(k, len(text)), (1 << 64) - 1, []
    hashes = []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * winnowing._BASE + ord(c) + 1) & mask
        for _ in range(2):
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & mask
        hashes.append(h >> 32)
    w = min(w, len(hashes))
    for i in range(len(hashes) - w + 1):
        low = min(hashes[i : i + w])
        place = max(j for j in range(i, i + w) if hashes[j] == low)
        if not out or out[-1] != (low, place):
            out.append((low, place))
    return out


@pytest.mark.parametrize("k,w", [(1, 1), (1, 4), (5, 3), (7, 6), (16, 48)])
def test_winnowing_as_defined(k, w):
    rng = random.Random(k * 100 + w)
    for n in (0, 1, k - 1, k, k + w - 1, k + w, 200):
        text = "".join(rng.choice("ab é🙂") for _ in range(n))
        hashes, places = winnowing.fingerprint(text, k, w)
        assert list(zip(hashes.tolist(), places.tolist())) == plain_fingerprint(text, k, w)


def test_shared_passages_of_guaranteed_length_are_found():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(30):
        passage = word(winnowing.GRAM + winnowing.WINDOW - 1)
        a, _ = winnowing.fingerprint(word(rng.randrange(300)) + passage + word(200))
        b, _ = winnowing.fingerprint(word(rng.randrange(300)) + passage + word(100))
        assert set(a.tolist()) & set(b.tolist())


def test_short_near_copies_are_alike():
    """One character changed in a text of 40 to 100 characters; windows by length keep what larger ones keep."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for n, least in ((40, 0.75), (60, 0.95), (100, 0.99)):
        alike = 0
        for _ in range(200):
            a = text(n)
            i = rng.randrange(n)
            alike += winnowing.likeness(winnowing.fingerprint(a)[0], winnowing.fingerprint(a[:i] + "#" + a[i + 1 :])[0]) > 0
        assert alike >= 200 * least
    for n in (20, 100, 400, 3000):
        a = text(n)
        assert set(winnowing.fingerprint(a, w=winnowing.WINDOW)[1].tolist()) <= set(winnowing.fingerprint(a)[1].tolist())


def test_neighbours(spark):
    docs = spark.createDataFrame(documents(), COLUMNS)
    got = winnowing.with_neighbours(docs).collect()
    rows = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in documents()))
    want = Counter()
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        marks = [winnowing.fingerprint(x)[0] for x in (t, edited, following)]
        want[(None if i == -1 else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), winnowing.as_text(marks[0]), winnowing.as_text(marks[1]), winnowing.likeness(marks[0], marks[1]), winnowing.likeness(marks[0], marks[2]))] += 1
    assert Counter(map(tuple, got)) == want
    plain = winnowing.fingerprints(docs).collect()
    assert {(r.doc_id, winnowing.as_text(np.array(r.hashes, np.uint32))) for r in plain} == {(w[0], w[3]) for w in want}


def test_neighbours_of_one_and_of_no_row(spark):
    one = winnowing.with_neighbours(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    assert winnowing.with_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# joins
def brute_join(rows, k, num, den):
    upper = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                both = len(a & b)
                if den * both >= num * (len(a) + len(b) - both):
                    x, y = top(i), top(j)
                    up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(sets[i]), None if d is None else least[top(i)]) for i, (d, _) in enumerate(rows))


def near_corpus(seed, n=160):
    """A third of all rows are near copies of one text; others share passages, frequent words and short forms."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", *[f"w{i}" for i in range(60)]])
    passage = [word() for _ in range(25)]
    base = [word() for _ in range(rng.choice([12, 40, 90]))]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.34:
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.5:
            w = [word() for _ in range(rng.randrange(6))] + passage + [word() for _ in range(rng.randrange(5))]
        elif kind < 0.7:
            w = [rng.choice(["the", "of"]) for _ in range(rng.randrange(8))]
        elif rows and kind < 0.85:
            w = (rows[rng.randrange(len(rows))][1] or "").split() + [word()] * rng.randrange(2)
        else:
            w = [word() for _ in range(rng.randrange(300))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,more,frequent", [(1, 64, 16), (2, 2, 2), (3, 8, 4), (4, 64, 1)])
def test_join_against_brute_force(spark, monkeypatch, seed, more, frequent):
    monkeypatch.setattr(ngram_join, "MORE_HUBS", more)
    monkeypatch.setattr(ngram_join, "CENTRE_CLASSES", 4)
    if seed == 4:  # hubs and labels are joined by shuffle, and most keys are heavy
        monkeypatch.setattr(ngram_join, "HUB_BYTES", -1)
        monkeypatch.setattr(common, "PIECE_ROWS", 2)
    rows = near_corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num, den in ((4, 85, 100), (1, 60, 100))[: 2 if seed == 1 else 1]:
        got = ngram_join.link(df, k, num, den, frequent=frequent)
        assert Counter(map(tuple, got.collect())) == brute_join(rows, k, num, den)


def test_join_of_odd_rows(spark):
    got = ngram_join.link(spark.createDataFrame(documents(), COLUMNS), 4, 85, 100)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute_join([(r[0], r[1]) for r in documents()], 4, 85, 100)
    assert ngram_join.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        ngram_join.link(spark.createDataFrame([], "doc_id long, text string"), 4, 1, 2)


def test_one_id_with_several_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, b + " z")]
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    assert Counter(map(tuple, got.collect())) == brute_join(rows, 4, 85, 100)


@pytest.mark.parametrize("frequent", [1, 3, 10**6])
def test_index_misses_no_link(frequent):
    """Sets that link share an entry, whatever class their tokens are of."""
    rng = random.Random(frequent)
    for num, den in ((85, 100), (80, 100), (51, 100)):
        limit = ngram_join.Threshold(num, den)
        for _ in range(60):
            universe = rng.sample(range(1, 10**6), rng.choice([8, 30, 120, 400]))
            sets = []
            base = rng.sample(universe, rng.randint(4, len(universe)))
            for _ in range(6):
                s = [t for t in base if rng.random() > 0.06] + rng.sample(universe, 2)
                sets.append(set(s))
            df = Counter(t for s in sets for t in s)
            entries = []
            for s in sets:
                held = sorted((df[t], t) for t in s if df[t] > 1)
                found = ngram_join.signatures(np.array([t for _, t in held], np.int64), np.array([c for c, _ in held], np.int64), len(s), limit, frequent)
                entries.append({h: (len(s), p, b) for h, p, b in zip(*(x.tolist() for x in found))})
                assert len(found[0]) <= limit.slack(len(s)) * 2 + limit.differing(len(s)) + 3  # in proportion to the prefix
            for i in range(6):
                for j in range(i):
                    both = len(sets[i] & sets[j])
                    if sets[i] != sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                        met = [(entries[i][h], entries[j][h]) for h in entries[i].keys() & entries[j].keys()]
                        # an entry in common, and one at which the places allow for the link
                        assert any(both <= min(n - p, m - q) + min(a, b, (a + b) // 3) for (n, p, a), (m, q, b) in met)


def shared_passage(n, seed=9, groups=5):
    """n documents with one passage, in groups of templates whose words still more documents hold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(121)]
    bodies = [[word() for _ in range(80)] for _ in range(groups)]
    other = [[word() for _ in range(200)] for _ in range(groups)]
    edit = lambda w: [word() if rng.random() < 0.004 else x for x in w]
    rows = [edit(passage + bodies[i % groups]) for i in range(n)] + [edit(bodies[i % groups] + other[i % groups]) for i in range(2 * n)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_checked_pairs_grow_with_the_rows(spark, monkeypatch):
    """Documents that share a frequent passage but do not link are not checked pair by pair."""
    real, checked = ngram_join._compared, []

    def counted(pairs, *rest):
        checked[-1] += pairs.count()
        return real(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_compared", counted)
    for n in (150, 600):
        checked.append(0)
        rows = shared_passage(n)
        got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
        if n == 150:
            assert Counter(map(tuple, got)) == brute_join(rows, 4, 85, 100)
        assert len({r.component_id for r in got}) < n  # the templates' groups
    assert checked[1] <= 6 * checked[0] and checked[1] < 600 * 600 / 4


def test_shingle_sets_count_words_as_defined():
    texts = ["A b\tC\x0bd e", "a b c d e", "x", "", " \n", "a b c", "A B C", "é a\x85b c d", "a a a a a a"]
    sets = ngram_join.shingle_sets(texts, 4)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 1, 1, 1, 1]
    assert sets[0].tolist() == sets[1].tolist() and sets[5].tolist() == sets[6].tolist()
