"""Lanes, fusion, expansion and reranking on small crafted corpora."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill import providers
from lexmill.operators import evaluation, expansion, fusion, index, quantized, rerank, search
from lexmill.schemas import CATEGORIES

POINT = "chunk_id string, category string, audience string, topics array<string>, is_actual boolean, text string, chunk_vector array<float>, question_vectors array<array<float>>"
QUERY = "query_id int, query string, audience string, topic string, category string, vector array<float>, top_k int"


def point(i, v=None, category="labor_code", audience="both", topics=(), actual=True, text="", questions=None):
    return (str(i), category, audience, list(topics), actual, text, v, questions)


def lanes_of(spark, points, queries, **options):
    p, q = spark.createDataFrame(points, POINT), spark.createDataFrame(queries, QUERY)
    terms = index.postings(p, "chunk_id", "category")
    return search.lanes(p, terms, index.frequencies(terms), q, dims=4, n_queries=q.count(), **options)


def test_filters_and_missing_vectors(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    points = [point(1, one, audience="seeker"), point(2, one, audience="employer"), point(3, one, topics=["t"]), point(4, one, actual=False), point(5, None), point(6, [0.0] * 4), point(7, one, category="case_law")]
    queries = [(0, "", None, None, None, one, 5), (1, "", "seeker", None, None, one, 5), (2, "", "both", None, None, one, 5), (3, "", None, "t", None, one, 5), (4, "", None, None, "case_law", one, 5), (5, "", None, None, None, [0.0] * 4, 5)]
    got = {}
    for r in lanes_of(spark, points, queries).where("ordinal < 0").collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
        assert r.score == pytest.approx(1.0)
    assert got == {0: {"1", "2", "3", "7"}, 1: {"1", "3", "7"}, 2: {"3", "7"}, 3: {"3"}, 4: {"7"}}


def test_balanced_lanes_keep_small_categories(spark):
    near, off = [0.0, 0.0, 3.0, 0.0], [0.0, 1.0, 2.0, 0.0]
    points = [point(f"p{i:02}", near, category="federal_law") for i in range(31)] + [point("rare", off, category="authorial"), point("rarer", off, category="authorial")]
    queries = [(7, "", None, None, None, near, 5), (8, "", None, None, "federal_law", near, 5)]
    rows = lanes_of(spark, points, queries).collect()
    balanced = {(r.lane, r["rank"]): r.chunk_id for r in rows if r.query_id == 7}
    law, own = CATEGORIES.index("federal_law"), CATEGORIES.index("authorial")
    assert balanced == {(law, 1): "p00", (law, 2): "p01", (law, 3): "p02", (law, 4): "p03", (own, 1): "rare", (own, 2): "rarer"}
    flat = [(r["rank"], r.chunk_id, r.lane) for r in rows if r.query_id == 8]
    assert sorted(flat) == [(i + 1, f"p{i:02}", 0) for i in range(20)]


@pytest.mark.parametrize("sent,block,held", [(32 << 20, 4096, 500_000), (32 << 20, 7, 5), (-1, 7, 5)])
def test_dense_lanes_against_brute_force(spark, monkeypatch, sent, block, held):
    """Queries sent to the tasks or met in blocks; ties, filters, vectors of other sizes."""
    monkeypatch.setattr(search, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(search, "BLOCK_ROWS", block)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(search, "HELD_ROWS", held)
    rng = random.Random(5)
    vector = lambda: [float(rng.randrange(-1, 2)) for _ in range(3)]  # noqa: E731  many are equal
    points = [point(i, vector(), rng.choice(CATEGORIES), rng.choice(["seeker", "employer", "both"]), rng.choice([[], ["t"], ["t", "u"]]), questions=[vector() for _ in range(rng.randrange(4))]) for i in range(60)]
    points += [point("long", [1.0] * 4), point("none", None)]
    queries = [(q, "", rng.choice([None, "seeker", "both"]), rng.choice([None, "t", "u"]), rng.choice([None, *CATEGORIES[:2]]), vector(), 5) for q in range(9)]
    p, q = spark.createDataFrame(points, POINT), spark.createDataFrame(queries, QUERY)
    depths = search.Depths(dense=5, question=3, dense_per_category=2, question_per_category=1)
    lane = F.when(F.col("q_category").isNull(), F.concat_ws("/", "ordinal", "category")).otherwise(F.col("ordinal").cast("string"))
    limit = F.when(F.col("q_category").isNull(), F.when(F.col("ordinal") < 0, 2).otherwise(1)).otherwise(F.when(F.col("ordinal") < 0, 5).otherwise(3))
    found = search.dense_best(search.lane_vectors(p), q, 3, (depths.dense, depths.question), (depths.dense_per_category, depths.question_per_category)).withColumn("lane", lane)
    got = {(r.query_id, r.lane, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in search.best(found, limit, "query_id", "lane").collect()}
    want = {}
    size = lambda v: math.sqrt(sum(x * x for x in v))
    for n, _, audience, topic, category, w, _ in queries:
        lanes = {}
        for c, kind, who, topics, _, _, own, asked in points:
            for o, v in enumerate([own, *(asked or [])], -1):
                if v is None or len(v) != 3 or not any(v) or not any(w) or (audience and who not in (audience, "both")) or (topic and topic not in topics) or (category and kind != category):
                    continue
                lanes.setdefault(str(o) if category else f"{o}/{kind}", []).append((-round(sum(a * b for a, b in zip(v, w)) / size(v) / size(w), 9), c))
        for key, rows in lanes.items():
            top = (2 if key.startswith("-1") else 1) if not category else (5 if key == "-1" else 3)
            for i, (score, c) in enumerate(sorted(rows)[:top], 1):
                want[(n, key, i)] = (c, -score + 0.0)
    assert got == want and len(want) > 30


@pytest.mark.parametrize("block", [4096, 7])
def test_quantized_search_is_exact(spark, monkeypatch, block):
    """The same rows as on the vectors themselves: near ties, filters, balanced lanes; vectors without a code take no part."""
    monkeypatch.setattr(search, "BLOCK_ROWS", block)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 4)
    rng = random.Random(9)
    centre = [rng.gauss(0, 1) for _ in range(6)]
    vector = lambda: [c + rng.choice([0, 1e-3, 0.02, 0.5]) * rng.gauss(0, 1) for c in centre]
    points = [point(i, vector(), rng.choice(CATEGORIES[:3]), rng.choice(["seeker", "employer", "both"]), rng.choice([[], ["t"]]), actual=i % 10 > 0) for i in range(200)]
    points += [point("zero", [0.0] * 6), point("none", None), point("nan", [math.nan] + [1.0] * 5), point("long", [1.0] * 7), point("inf", [math.inf] + [1.0] * 5)]
    queries = [(q, "", rng.choice([None, "seeker"]), rng.choice([None, "t"]), rng.choice([None, None, CATEGORIES[0]]), vector(), 5) for q in range(10)] + [(20, "", None, None, None, [0.0] * 6, 5)]
    p, q = quantized.with_codes(spark.createDataFrame(points, POINT)), spark.createDataFrame(queries, QUERY)
    coded = {r.chunk_id: (r.chunk_code, r.chunk_scale) for r in p.collect()}
    assert all(coded[c] == (None, None) for c in ("zero", "none", "nan", "inf")) and len(coded["5"][0]) == 6 and max(abs(b if b < 128 else b - 256) for b in coded["5"][0]) == 127
    finite = p.where("chunk_id not in ('nan', 'inf')")
    for balanced in (None, 3):
        lane = F.when(F.col("q_category").isNull() & F.lit(balanced is not None), F.col("category"))
        limit = F.when(F.col("lane").isNotNull(), balanced or 0).otherwise(5)
        ranked = lambda df: sorted((r.query_id, r.lane or "", r["rank"], r.chunk_id, round(r.score, 9)) for r in search.best(df.withColumn("lane", lane), limit, "query_id", "lane").collect())  # noqa: E731, B023
        exact = search.dense_best(search.lane_vectors(finite, questions=False), q, 6, (5, 5), balanced and (balanced, balanced))
        found = quantized.quantized_best(p, q, 6, 5, balanced)
        assert ranked(found) == ranked(exact) and found.count() < exact.select("query_id").distinct().count() * 150
    monkeypatch.setattr(search, "BROADCAST_BYTES", -1)
    assert len(ranked(quantized.quantized_best(finite, q, 6, 5, 3))) == len(ranked(exact))


def test_codes_take_a_quarter_of_the_vectors(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(2)
    df = spark.createDataFrame([point(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(1000)], POINT).coalesce(1)
    quantized.with_codes(df).write.parquet(f"{tmp_path}/p")
    meta = pq.ParquetFile(next((tmp_path / "p").glob("*.parquet"))).metadata.row_group(0)
    size = {meta.column(i).path_in_schema.split(".")[0]: meta.column(i).total_compressed_size for i in range(meta.num_columns)}
    assert size["chunk_code"] + size["chunk_scale"] < 0.35 * size["chunk_vector"]


def test_question_vectors_reach_their_chunk(spark):
    one, two = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    points = [point(i, two) for i in range(25)] + [point("t", [0.0, 1.0, 0.0, 0.0], questions=[one, two, two, two, two, one])]
    rows = lanes_of(spark, points, [(0, "", None, None, "labor_code", one, 5)]).where("score > 0.5").collect()
    assert [(r.chunk_id, r.ordinal, r.lane) for r in rows] == [("t", 0, 5)]  # a sixth question has no slot


def test_sparse_lane(spark):
    points = [point(1, text="Квота для инвалидов квота"), point(2, text="квота"), point(3, text="отпуск"), point(4, text="квота", actual=False)]
    rows = lanes_of(spark, points, [(0, "квота отпуск", None, None, "labor_code", None, 5), (1, "— !", None, None, None, None, 5)]).collect()
    assert [r.query_id for r in rows] == [0, 0, 0]
    scores = {r.chunk_id: r.score for r in rows}
    assert scores["1"] == pytest.approx(2 * scores["2"]) and {r.lane for r in rows} == {30}


def fuse(spark, lists, k=60):
    rows = [(0, lane, rank, c) for lane, items in enumerate(lists) for rank, c in enumerate(items, 1)]
    out = fusion.rrf(spark.createDataFrame(rows, "query_id int, lane int, rank int, chunk_id string"), "query_id", k=k)
    return [(r.chunk_id, r.score) for r in out.orderBy("rank").collect()]


def test_rrf(spark):
    got = fuse(spark, [["p", "q", "r", "s"], ["q", "t"], ["t", "p"]])
    assert got[0] == ("p", 1 / 61 + 1 / 62) and got[1][0] == "q" and got[2] == ("t", 1 / 62 + 1 / 61)  # ties: the first seen
    assert [c for c, _ in got] == ["p", "q", "t", "r", "s"]
    assert [c for c, _ in fuse(spark, [["m", "n"], ["o", "n"]])] == ["n", "m", "o"]  # twice second beats once first
    assert fuse(spark, [["m", "n"]], k=3) == [("m", 0.25), ("n", 0.2)]
    assert [c for c, _ in fuse(spark, [[], ["n", "m"], []])] == ["n", "m"]


def test_one_variant_keeps_only_ranks(spark):
    lists = [["u", "v", "w"], ["w", "u"], ["w", "x"]]
    rows = [(3, 0, lane, rank, c) for lane, items in enumerate(lists) for rank, c in enumerate(items, 1)]
    df = spark.createDataFrame(rows, "query_id int, variant_id int, lane int, rank int, chunk_id string")
    out = fusion.fuse_variants(fusion.rrf(df, "query_id", "variant_id"), "query_id").orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in out] == [("w", 1 / 61), ("u", 1 / 62), ("v", 1 / 63), ("x", 1 / 64)]


def test_expansion(spark):
    v = lambda s, *r: {"sub_question": s, "rephrasings": list(r)}
    answers = [
        json.dumps({"variants": [v("a", "b", "x"), v("c", "d"), v("a"), v("beyond")]}), json.dumps({"variants": [v(" ", "b"), v("b", " ")]}), '{"variants": []}', None, "not json",
        json.dumps({"variants": [{"sub_question": "only"}]}), '```json\n{"_variants_": [{"sub_question": "**fenced", "rephrasings": []}]}\n```',
    ]
    df = spark.createDataFrame([(i, "q", a) for i, a in enumerate(answers)], "query_id int, query string, answer string")
    got = {}
    for r in expansion.expand(df).orderBy("query_id", "variant_id").collect():
        got.setdefault((r.query_id, r.expansion_status), []).append(r.query)
        assert r.original_query == "q"
    assert got == {(0, "ok"): ["a", "b", "c", "d"], (1, "ok"): ["b"], (2, "ok"): ["q"], (3, "fallback_unavailable"): ["q"], (4, "fallback_unavailable"): ["q"], (5, "ok"): ["only"], (6, "ok"): ["fenced"]}


def test_rerank(spark):
    """Numbers out of range and repeats go, then the first top_k stay; without any valid one the fused order does."""
    answers = {0: [4, 2, 6], 1: [6, 0, 6, -1, 3, 8, 1], 2: [0, 8, -3], 3: [], 4: None, 5: [2]}
    queries = spark.createDataFrame([(q, 2, a) for q, a in answers.items()], "query_id int, top_k int, indices array<int>")
    fused = spark.createDataFrame([(q, f"c{n}", 1.0 / n, n) for q in range(5) for n in range(1, 8)], "query_id int, chunk_id string, score double, rank int")
    got = {}
    for r in rerank.rerank(queries, fused).orderBy("query_id", "position").collect():
        got.setdefault((r.query_id, r.rerank_status), []).append((r.position, r.chunk_id))
    assert got == {
        (0, "ok"): [(1, "c4"), (2, "c2")], (1, "ok"): [(1, "c6"), (2, "c3")],
        (2, "fallback_invalid_output"): [(1, "c1"), (2, "c2")], (4, "fallback_unavailable"): [(1, "c1"), (2, "c2")],
    }
    status = {r.query_id: (r.rerank_status, r.results) for r in rerank.statuses(queries, fused).collect()}
    assert status[3] == ("no_relevant", 0) and status[5] == ("no_candidates", 0) and status[0] == ("ok", 2)
    outcome = lambda e, s, n, x=None: spark.range(1).select(rerank.outcome(F.lit(e), F.lit(s), F.lit(n), F.lit(x).cast("string"))).first()[0]
    got = [outcome("ok", "ok", 1), outcome("ok", "no_relevant", 0), outcome("fallback_unavailable", "ok", 1), outcome("ok", "fallback_invalid_output", 0), outcome("ok", "not_started", 0, "gone")]
    assert got == ["ok", "empty", "degraded", "degraded", "error"]


def test_candidates_and_prompts(spark):
    schema = "source_title string, category string, section_number string, section_title string, effective_date date, version string, text string, rank int, q int, query string"
    df = spark.createDataFrame([("S", "case_law", "", None, None, "v1", "body", 2, 0, "why?"), (None, "x", "5", "T", None, "", "b" * 3000, 1, 0, "why?")], schema)
    rows = df.withColumn("candidate", rerank.candidate_text())
    head = "[source_title=None | category=x | section_number=5 | section_title=T]\n"
    assert [r.candidate for r in rows.orderBy("rank").collect()] == [head + "b" * 3000, "[source_title=S | category=case_law | version=v1]\nbody"]
    # by hand: the query in its tags, a blank line, the heading, then candidates with a blank line between them
    want = '<user_query>why?</user_query>\n\nКандидаты:\n<candidate id="1">' + head + "b" * (2500 - len(head)) + '</candidate>\n\n<candidate id="2">[source_title=S | category=case_law | version=v1]\nbody</candidate>'
    assert rerank.prompts(rows, "q").first().prompt == want

    class Model:
        def answer(self, prompt):
            assert prompt == want
            return '```json\n{"ranked_indices": [2, 9]}\n```'

    ranking = providers.ModelReranker(Model())
    assert ranking.rerank("why?", [r.candidate for r in rows.orderBy("rank").collect()], 5) == [2, 9]
    for bad in ('{"ranked_indices": ["1"]}', "[1]", "{}", "no"):
        ranking.model.answer = lambda _, bad=bad: bad
        with pytest.raises(ValueError):
            ranking.rerank("q", [], 5)


def test_retrieval_quality(spark):
    rows = [("a", -1, [1.0, 0.0]), ("b", -1, [0.0, 1.0]), ("a", 0, [1.0, 0.1]), ("a", 1, [0.0, 1.0]), ("b", 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows + [("c", 0, [1.0, 0.0]), ("a", 2, [0.0, 0.0])], "chunk_id string, ordinal int, v array<double>")
    for block in (4096, 1):
        quality = evaluation.retrieval_quality(df, block)
        assert tuple(quality.first()) == (3, 0.333333, 1.0, pytest.approx(2 / 3, abs=1e-6))
        assert "Cartesian" not in quality._jdf.queryExecution().executedPlan().toString()


def test_ranks_that_single_precision_cannot_tell(spark, monkeypatch):
    """Equal vectors and such that differ by a millionth of each other, in many blocks and tiles."""
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    own = {f"c{i:02}": base[i % 6] * (1 + i) + (1e-6 * rng.normal(size=8) if i % 3 else 0) for i in range(40)}
    asked = [(f"c{i:02}", j, base[(i + j) % 6] + (0.1 * rng.normal(size=8) if j else 0)) for i in range(40) for j in range(2)]
    unit = lambda x: x / np.sqrt((x * x).sum())
    ranks = []
    for of, _, q in asked:
        score = {k: round(float(unit(q) @ unit(w)), 9) for k, w in own.items()}
        ranks.append(1 + sum(s > score[of] or s == score[of] and k < of for k, s in score.items()))
    want = (len(asked), round(sum(r <= 1 for r in ranks) / len(ranks), 6), round(sum(r <= 5 for r in ranks) / len(ranks), 6), round(sum(1 / r for r in ranks) / len(ranks), 6))
    df = spark.createDataFrame([(k, -1, w.tolist()) for k, w in own.items()] + [(k, j, q.tolist()) for k, j, q in asked], "chunk_id string, ordinal int, v array<double>")
    monkeypatch.setattr(evaluation, "FINE_BLOCK", 9)
    for block in (4096, 16):
        assert tuple(evaluation.retrieval_quality(df, block).first()) == pytest.approx(want, abs=1e-6)


def test_blocks_that_meet_are_few():
    """600,000 chunks and 2.4 million questions: rows that are shuffled, each 64 numbers, are tens of millions."""
    chunks, questions = evaluation._blocks(600_000, 2_400_000, evaluation.BLOCK)
    assert chunks * 2_400_000 + questions * 600_000 < 80_000_000
    assert evaluation._blocks(10_000, 40_000, evaluation.BLOCK) == (1, 10)


def test_codes_are_computed_once_a_vector(spark):
    """Lengths and scales aren't part of the lambdas that go over a vector's components."""
    df = quantized.with_codes(spark.createDataFrame([([1.0, -2.0, 0.5],), (None,), ([0.0],)], "chunk_vector array<float>"))
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 2
    rows = df.collect()
    assert [None if r.chunk_code is None else list(r.chunk_code) for r in rows] == [[64, 129, 32], None, None] and rows[0].chunk_scale == pytest.approx(2 / math.sqrt(5.25) / 127)


def test_postings_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([("d", "1", "x", "a B a b ёж еж a"), ("d", "2", "y", None), ("e", "3", None, "ТК РФ ст.5"), ("e", "4", "z", "- ")], "document_id string, chunk_id string, category string, text string")
    made = index.indexed(df)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r.chunk_id, r.token)
    counted = index.postings(df, "document_id", "chunk_id", "category").select(*made.columns)
    assert sorted(made.collect(), key=key) == sorted(counted.collect(), key=key) and made.count() == 6


def test_floors_where_many_chunks_share_the_highest_frequency(spark, monkeypatch):
    monkeypatch.setattr(search, "DIRECT_POSTINGS", -1)
    monkeypatch.setattr(index, "SEEDS", 10)
    p = spark.createDataFrame([point(i, text="common rare" if i % 4 == 0 else "common") for i in range(600)], POINT)
    q = spark.createDataFrame([(0, "common rare", None, None, None, None, 5)], QUERY)
    terms = index.postings(p, "chunk_id", "category")
    found = {r.chunk_id for r in search.sparse_best(p, terms, index.frequencies(terms), q, 600, 2).collect()}
    assert found == {str(i) for i in range(0, 600, 4)}


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    """Small tables of the provided form."""
    path = tmp_path_factory.mktemp("corpus")
    words = ["квота", "отпуск", "договор", "срок", "работа", "закон", "труд"]
    text = lambda i: " ".join(words[(i * k + k) % 7] for k in range(1, 9)) + f" n{i}"
    spark.createDataFrame([(i, text(i), "en", f"src{i % 4}", 9) for i in range(120)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    vector = lambda i: [float((i * (j + 3)) % 11 - 5) for j in range(64)]
    spark.createDataFrame([(i, vector(i), 0) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(i, text(i * 3)) for i in range(20)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_dense_searches_need_no_term_index(spark, corpus_dir):
    from lexmill.plans import corpus, registry

    before = corpus.stored(spark, corpus_dir, terms=False)
    registry.QUERIES["dense_search"](spark, corpus_dir).collect()
    assert (spark.sparkContext.applicationId, corpus_dir, True) not in corpus._stored and not before.parts["postings"]
    assert corpus.stored(spark, corpus_dir).parts["points"] == before.parts["points"]


def test_searches_read_stored_tables_once(spark, corpus_dir):
    from lexmill.plans import corpus, registry, retrieval

    now = corpus.stored(spark, corpus_dir)
    assert corpus.stored(spark, corpus_dir) is now
    plan = retrieval.one_search(spark, corpus_dir, "sparse_search")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan or "PushedFilters: [IsNotNull(token), In(token" in plan
    batch = registry.QUERIES["sparse_search"](spark, corpus_dir).where("query_id = 4").collect()
    assert sorted(map(tuple, retrieval.one_search(spark, corpus_dir, "sparse_search", 4).collect())) == sorted(map(tuple, batch))


def test_stored_postings_follow_the_points(spark):
    kind = "document_id string, chunk_id string, category string, version string, chunk_index int, text string"
    old = spark.createDataFrame([("a", "a0", "x", "v1", 0, "one two"), ("b", "b0", "x", "v1", 0, "two three")], kind)
    stored = index.indexed(old)
    new = old.limit(0).union(spark.createDataFrame([("a", "a0", "x", "v2", 0, "four four"), ("a", "a1", "x", "v2", 1, "two")], old.schema))
    after = old.where("document_id = 'b'").union(new)
    terms, fresh, gone = index.refreshed(stored, after, new)
    brief = lambda df: sorted((r.chunk_id, r.token, r.tf) for r in df.collect())
    assert brief(terms) == [("a0", "four", 2.0), ("a1", "two", 1.0), ("b0", "three", 1.0), ("b0", "two", 1.0)]
    assert brief(fresh) == [("a0", "four", 2.0), ("a1", "two", 1.0)] and brief(gone) == [("a0", "one", 1.0), ("a0", "two", 1.0)]
    assert sorted(map(tuple, index.frequencies(fresh, gone).collect())) == [("four", 2.0, 1), ("one", 1.0, -1)]


def zipf(rng, n):
    return " ".join(f"t{min(int(rng.paretovariate(0.6)), 40)}" for _ in range(n))


@pytest.mark.parametrize("direct,sent,pushed,seeds,piece", [(1 << 20, 32 << 20, 16, 256, 1 << 20), (-1, 32 << 20, 16, 3, 1 << 20), (-1, -1, 0, 3, 7)])
def test_pruned_term_search_against_brute_force(spark, monkeypatch, direct, sent, pushed, seeds, piece):
    """Ties, filters, common tokens, long and short chunks; postings looked up or joined, with frequent tokens dealt out."""
    monkeypatch.setattr(search, "DIRECT_POSTINGS", direct)
    for module, name, value in ((search, "BROADCAST_BYTES", sent), (search, "PUSHED_QUERIES", pushed), (index, "SEEDS", seeds), (search, "PIECE_ROWS", piece)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(8)
    points = [point(i, category=rng.choice(CATEGORIES[:3]), audience=rng.choice(["seeker", "employer", "both"]), topics=rng.choice([[], ["t"]]), actual=i % 9 > 0, text=zipf(rng, rng.choice([3, 12, 80]))) for i in range(150)]
    points += [point("x1", text="t1 t1 rare"), point("x2", text="t1 t1 rare"), point("e", text="")]
    queries = [(q, zipf(rng, rng.choice([1, 4, 15])), rng.choice([None, None, "seeker"]), rng.choice([None, "t"]), rng.choice([None, None, CATEGORIES[1]]), None, 5) for q in range(12)] + [(50, "rare t1 nowhere", None, None, None, None, 5), (51, "—", None, None, None, None, 5)]
    p, q = spark.createDataFrame(points, POINT), spark.createDataFrame(queries, QUERY)
    terms = index.postings(p, "chunk_id", "category").cache()
    counts = index.frequencies(terms)
    count = lambda text: {t: text.split().count(t) for t in text.split()}
    held = {c: count(text) for c, _, _, _, _, text, _, _ in points}
    idf = {}
    for t in {t for h in held.values() for t in h}:
        n = sum(t in h for h in held.values())
        idf[t] = round(math.log(1 + (len(points) - n + 0.5) / (n + 0.5)), 9)
    for balanced in (None, 2):
        lane = F.when(F.col("q_category").isNull() & F.lit(balanced is not None), F.col("category"))
        limit = F.when(F.col("lane").isNotNull(), balanced or 0).otherwise(4)
        found = search.sparse_best(p, terms, counts, q, len(points), 4, balanced)
        assert found.columns == ["query_id", "chunk_id", "category", "q_category", "score"]
        got = {(r.query_id, r.lane, r["rank"]): (r.chunk_id, round(r.score, 6)) for r in search.best(found.withColumn("lane", lane), limit, "query_id", "lane").collect()}
        want = {}
        for n, text, audience, topic, category, _, _ in queries:
            lanes = {}
            for c, kind, who, topics, actual, _, _, _ in points:
                if not actual or (audience and who not in (audience, "both")) or (topic and topic not in topics) or (category and kind != category):
                    continue
                shared = [k * held[c][t] * idf[t] for t, k in count(text).items() if t in held[c]]
                if shared:
                    lanes.setdefault(kind if balanced and not category else None, []).append((-round(sum(shared), 9), c))
            for key, rows in lanes.items():
                for i, (score, c) in enumerate(sorted(rows)[: 4 if key is None else 2], 1):
                    want[(n, key, i)] = (c, round(-score, 6))
        assert got == want and len(want) > 20


def test_few_postings_are_met(spark, monkeypatch):
    """Of long lists most postings are below what reaches a lane: under half meet the query."""
    rng = random.Random(3)
    points = [point(f"{i:04}", text=" ".join(["common"] * (1 + int(rng.expovariate(0.3))) + ["often"] * (1 + i % 3) + [f"own{i}"])) for i in range(3000)]
    p, q = spark.createDataFrame(points, POINT), spark.createDataFrame([(0, "common often own17", None, None, "labor_code", None, 5)], QUERY)
    terms = index.postings(p, "chunk_id", "category")
    monkeypatch.setattr(search, "DIRECT_POSTINGS", -1)
    met, real = [], search._met

    def counted(*args):
        out = real(*args)
        met.append(out)
        return out

    search._met = counted
    try:
        found = search.sparse_best(p, terms, index.frequencies(terms), q, 3000, 20)
        assert len(search.best(found, F.lit(20), "query_id").collect()) == 20
        seeds, hits = met
        assert seeds.where("tf >= seed_tf").count() + hits.where("tf > coalesce(all, 0)").count() < 0.25 * hits.count()
    finally:
        search._met = real


def test_idf_stores_nothing(spark, corpus_dir, monkeypatch):
    from lexmill.plans import corpus, registry

    monkeypatch.setattr(corpus, "stored", lambda *_, **__: pytest.fail("the corpus was stored"))
    chunks = corpus.points(spark, corpus_dir, vectors=False)
    want = index.idf(index.frequencies(index.indexed(chunks)), 120).withColumn("idf", F.round("idf", 6))
    got = registry.QUERIES["idf"](spark, corpus_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 120


def test_chunks_are_counted_as_their_postings_are(spark):
    df = spark.createDataFrame([("d", "1", "x", "a B a b ёж еж a"), ("d", "2", "y", None), ("e", "3", None, "a a a b"), ("e", "4", "z", "- ")], "document_id string, chunk_id string, category string, text string")
    key = lambda r: (r.token, r.tf)
    made = index.counted(df)
    assert made.schema.simpleString() == index.FREQUENCIES.simpleString()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, index.frequencies(index.indexed(df)).collect())) == [("a", 3.0, 2), ("b", 1.0, 1), ("b", 2.0, 1), ("еж", 2.0, 1)]


def test_batches_of_searches_store_no_postings(spark, corpus_dir, monkeypatch):
    from lexmill.plans import corpus, registry

    monkeypatch.setattr(corpus, "_stored", {})
    monkeypatch.setattr(index, "indexed", lambda *_: pytest.fail("postings were made"))
    for name in ("search_trace", "search_outcomes", "search_lanes", "rerank", "fuse_variants", "sparse_search"):
        assert registry.QUERIES[name](spark, corpus_dir).count() > 0
    now = corpus.stored(spark, corpus_dir, terms=corpus.COUNTS)
    assert not now.parts["postings"] and len(now.parts["points"]) == 1


@pytest.mark.parametrize("cells,held,sent", [(1 << 22, 500_000, 32 << 20), (60, 40, 32 << 20), (1 << 22, 500_000, -1)])
def test_texts_scored_where_they_are_read(spark, monkeypatch, cells, held, sent):
    """Against postings: ties, filters, chunks without text, blocks of rows and queries; queries that can't be sent to all tasks meet postings."""
    for name, value in (("TEXT_CELLS", cells), ("HELD_ROWS", held), ("BROADCAST_BYTES", sent)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(4)
    points = [point(i, category=rng.choice(CATEGORIES[:3]), audience=rng.choice(["seeker", "employer", "both"]), topics=rng.choice([[], ["t"]]), actual=i % 9 > 0, text=zipf(rng, rng.choice([3, 12, 80]))) for i in range(150)]
    points += [point("x1", text="t1 t1 rare"), point("x2", text="t1 t1 rare"), point("e", text=""), point("n", text=None)]
    queries = [(q, zipf(rng, rng.choice([1, 4, 15])), rng.choice([None, None, "seeker"]), rng.choice([None, "t"]), rng.choice([None, None, CATEGORIES[1]]), None, 5) for q in range(20)] + [(50, "rare t1 nowhere", None, None, None, None, 5), (51, "—", None, None, None, None, 5)]
    p, q = spark.createDataFrame(points, POINT).repartition(3), spark.createDataFrame(queries, QUERY)
    terms = index.postings(p, "chunk_id", "category").cache()
    counts = index.frequencies(terms)
    given = []
    for balanced in (None, 2):
        lane = F.when(F.col("q_category").isNull() & F.lit(balanced is not None), F.col("category"))
        limit = F.when(F.col("lane").isNotNull(), balanced or 0).otherwise(4)
        ranked = lambda df: sorted((r.query_id, r.lane or "", r["rank"], r.chunk_id, round(r.score, 6)) for r in search.best(df.withColumn("lane", lane), limit, "query_id", "lane").collect())  # noqa: E731, B023
        found = search.sparse_best(p, lambda: given.append(1) or terms, counts, q, len(points), 4, balanced)
        assert found.columns == ["query_id", "chunk_id", "category", "q_category", "score"]
        assert ranked(found) == ranked(search.sparse_best(p, terms, counts, q, len(points), 4, balanced)) and found.count() > 20
    assert bool(given) == (sent < 0)
