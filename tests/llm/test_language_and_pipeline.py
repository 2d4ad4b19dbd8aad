"""Language identification, and the corpus pipeline as a whole."""

import random
from collections import Counter

import numpy as np
import pytest
from cases import COLUMNS, documents
from pyspark.sql import functions as F

from lexmill.llm import language_id as lid

SYLLABLES = {"en": ["th", "ing", "and", "er", "ly"], "de": ["sch", "ung", "ein", "ß", "keit"], "fr": ["eau", "que", "é", "oi", "ç"]}


def prose(lang, words, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def labelled(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", "fr"])
        out.append((i, prose(lang, rng.choice([3, 30, 300]), rng), lang))
    return out


@pytest.fixture(scope="module")
def net(spark):
    return lid.train(spark.createDataFrame(labelled(), "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark, net):
    rows = labelled(150, 2)
    got = {r.doc_id: r for r in lid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 145
    assert all(0 <= r.score <= 1 for r in got.values())


def test_prediction_is_the_plain_convolution(net):
    """Paired tables and batches give what one filter position after another gives."""
    window = np.frombuffer(prose("de", 40, random.Random(3)).encode()[: lid.WINDOW], np.uint8)
    features = []
    for table, bias in zip(net.tables, net.biases):
        at = [sum(table[o][window[i + o]] for o in range(len(table))) for i in range(len(window) - len(table) + 1)]
        features.append(np.maximum(np.max(at, axis=0) + bias, 0))
    logits = np.concatenate(features) @ net.dense + net.dense_bias
    want = np.exp(logits - logits.max())
    assert np.allclose(net.probabilities(window[None])[0], want / want.sum(), atol=1e-5)


def test_windows_cover_the_whole_text():
    data = bytes(range(1, 200)) * 3
    cut = lid.windows_of(data)
    assert cut.shape == (5, lid.WINDOW) and cut.tobytes().startswith(data) and set(cut.tobytes()[len(data) :]) == {32}
    assert lid.windows_of(b"").shape == (1, lid.WINDOW)


def test_odd_rows(spark, net):
    docs = spark.createDataFrame(documents(), COLUMNS)
    got = lid.predict(docs, net, keep=("doc_id", "score", "text"))
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    for r in got.collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in net.labels
    same = Counter((r.text, r.lang_pred, r.score) for r in got.collect())
    assert len({t for t, _, _ in same}) == len(same)  # equal texts, equal predictions
    assert lid.predict(docs.limit(0), net).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "12", "en")], "doc_id long, text string, lang string")
    assert lid.train(docs) is None
    assert {r.lang_pred for r in lid.predict(docs, None).collect()} == {"und"}


def test_reruns_and_partitions_agree(spark, net):
    again = lid.train(spark.createDataFrame(labelled(), "doc_id long, text string, lang string").repartition(5))
    assert again.key == net.key


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"the text {i}", "en" if i % 2 else "de") for i in range(2000)], "doc_id long, text string, lang string")
    seen = []
    original = lid.fit
    lid.fit = lambda windows, *a, **k: seen.append(len(windows)) or original(windows[:64], *[x[:64] if isinstance(x, np.ndarray) else x for x in a], epochs=1, **k)
    try:
        lid.train(docs, per_label=100)
        lid.train(docs, per_label=100, most=61)
    finally:
        lid.fit = original
    assert seen == [200, 60]  # hard limits, of each label and in all
    with pytest.raises(ValueError):
        lid.train(docs, most=1)


@pytest.mark.parametrize("first", [True, False])
def test_a_repeated_text_neither_fills_nor_empties_the_sample(spark, monkeypatch, first):
    """40,000 copies of the text that comes first, or last, by hash, and another label's only text as often."""
    texts = spark.range(1000).select(F.concat(F.lit("the text "), F.col("id")).alias("text"))
    mark = F.xxhash64(F.lit(17), "text")
    drawn = texts.orderBy(mark if first else mark.desc()).first().text
    docs = texts.unionByName(spark.range(40_000).select(F.lit(drawn).alias("text"))).withColumn("lang", F.lit("en"))
    docs = docs.unionByName(spark.range(40_000).select(F.lit("ein Text").alias("text"), F.lit("de").alias("lang")))
    docs = docs.unionByName(spark.createDataFrame([("12", "xx"), (None, "xx")], "text string, lang string"))
    seen = []
    monkeypatch.setattr(lid, "fit", lambda windows, marks, labels: seen.append(([w.tobytes() for w in windows], labels)))
    lid.train(docs, per_label=100)
    windows, labels = seen[0]
    assert len(windows) == 101 and len(set(windows)) == 101 and labels == ["de", "en"]
    assert any(w.startswith(drawn.encode().ljust(lid.WINDOW)) for w in windows) == first


# the pipeline
@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, t, lang, f"s{i % 4}", len(t)) for i, t, lang in labelled(120, 5)]
    rows += [(1000 + i, None if i == 0 else " 12 %" * i, "en", "s1", i) for i in range(4)]
    rows += [(2000 + i, rows[7][1], "en", "s0", 1) for i in range(5)]
    rows += [(3000, prose("en", 200, rng), "en", None, 1), (3000, rows[9][1], "en", "s2", 1), (None, "the thing and the king", None, "s1", None)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_stages_one_by_one(spark, stored):
    import corpus_pipeline
    from test_similarity import brute_join

    path, rows = stored
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "source_mix", "bpe_codec"]
    kept = corpus_pipeline.identify_language(spark, docs, path)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert not {1000, 1001, 1002, 1003} & set(ids) and len(ids) > 120 and ids[None] == 1
    one = corpus_pipeline.keep_one_of_each_group(spark, kept, path)
    assert one.columns == docs.columns
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    found = brute_join(pairs, 5, 80, 100)  # no two rows are equal in id and text
    want = Counter(d for d, _, c in found.elements() if d is None or c == d)
    assert want[3000] == 1
    assert Counter(r.doc_id for r in one.collect()) == want
    mixed = corpus_pipeline.mix_sources(spark, one, path)
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.where("doc_id < 3000").collect()).values()) <= 2
    coded = corpus_pipeline.encode_tokens(spark, mixed, path)
    assert coded.count() == mixed.count()
    assert coded.where(F.octet_length("ids") != F.col("n_tokens") * 4).count() == 0


def test_the_whole_pipeline(spark, stored):
    """Against the predictions, a join by brute force, the mix of what these leave, and the tokenizers library."""
    P = pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from test_similarity import brute_join
    from tokenizers import Tokenizer

    from lexmill.llm import mixing, ngram_join
    from lexmill.llm.queries import MIX_MOST, MIX_SHARE, MIX_WEIGHTS

    path, rows = stored
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = lid.predict(docs, lid.train(docs), keep=tuple(docs.columns)).collect()
    kept = [r for r in judged if r.lang_pred != lid.UNKNOWN and r.score >= corpus_pipeline.LEAST_SCORE]
    assert 0 < len(kept) < len(rows)
    groups = brute_join([(r.doc_id, r.text) for r in kept], 5, 80, 100)
    size = lambda t: len(ngram_join.shingle_sets([t], 5)[0])
    one = [tuple(r[c] for c in docs.columns) for r in kept if r.doc_id is None or groups[(r.doc_id, size(r.text), r.doc_id)]]
    assert len(one) < len(kept) and sum(r[0] == 3000 for r in one) == 1
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in mixing.mix(spark.createDataFrame(one, docs.schema), MIX_WEIGHTS, share=MIX_SHARE, most=MIX_MOST).collect():
        code = library.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, r.lang, r.source, len(code), np.array(code, "<u4").tobytes(), library.decode(code, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.lang, r.source, r.n_tokens, bytes(r.ids), r.decoded) for r in out.collect()) == want and len(want) > 50
    again = corpus_pipeline.run(spark, path)
    assert Counter((r.doc_id, bytes(r.ids)) for r in again.collect()) == Counter((r.doc_id, bytes(r.ids)) for r in out.collect())


def test_stages_take_odd_and_no_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(documents(), COLUMNS)
    for rows in (docs.withColumn("lang", F.lit(None).cast("string")), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, "unused")
            assert out.count() <= 2 * rows.count()
