"""Token counts, BPE encoding and token files against the public libraries."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from cases import COLUMNS, documents  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from lexmill.llm import bpe, bpe_codec, token_counts, token_files  # noqa: E402
from lexmill.llm.files import open_file  # noqa: E402

TEXTS = st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]) | st.sampled_from(list(" \n\t'▁aeinrst.,19")), max_size=80)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return {
        "piece": sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")),
        "word": Tokenizer.from_file(P.path("word_bpe_49k.json")),
        "byte": Tokenizer.from_file(P.path("byte_bpe_50k.json")),
    }


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_as_sentencepiece(library, text):
    assert bpe.piece_counter(P.path("piece_bpe_32k.model")).count(text) == len(library["piece"].encode(text))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encodes_and_decodes_as_tokenizers(library, text):
    codec = bpe.word_bpe(P.path("word_bpe_49k.json"))
    ids = codec.encode(text)
    want = library["word"].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert codec.decode(ids) == library["word"].decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_level_as_tokenizers(library, text):
    got = token_files.encoder(P.path("byte_bpe_50k.json")).encode([text])[0]
    assert np.frombuffer(got, "<u2").tolist() == library["byte"].encode(text, add_special_tokens=False).ids


def test_merge_takes_lowest_rank_leftmost_and_skips_stale_entries():
    symbols = list("abab")
    assert bpe.merge(symbols, {"ab": 1, "ba": 0}) == 1
    assert symbols == ["a", "ba", "", "b"]
    symbols = list("aaaaa")
    assert bpe.merge(symbols, {"aa": 0, "aaaa": 1}) == 3
    assert [s for s in symbols if s] == ["aaaa", "a"]
    assert bpe.merge([], {}) == 0


def test_words_are_cached_within_bounds():
    cache = bpe.WordCache(len, limit=3)
    assert [cache[w] for w in ("a", "bb", "ccc", "dddd", "e" * 100)] == [1, 2, 3, 4, 100]
    assert len(cache) <= 3 and "e" * 100 not in cache


def test_count_operator(spark, library):
    docs = spark.createDataFrame(documents(), COLUMNS)
    out = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"))
    want = Counter((r[0], len((r[1] or "").encode()), n := len(library["piece"].encode(r[1] or "")), n > 4096) for r in documents())
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, out.collect())) == want
    assert token_counts.count_tokens(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_codec_operator(spark, library):
    docs = spark.createDataFrame(documents(), COLUMNS)
    vocab = P.path("word_bpe_49k.json")
    out = bpe_codec.encode(docs, vocab, keep=("doc_id", "score", "ids"))  # a column named like an output gives way
    assert out.columns == ["doc_id", "score", "ids", "decoded"]
    rows = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in out.collect())
    ids = lambda t: library["word"].encode(t or "", add_special_tokens=False).ids
    assert rows == Counter((r[0], np.array(ids(r[1]), "<u4").tobytes(), library["word"].decode(ids(r[1]), skip_special_tokens=False)) for r in documents())
    again = bpe_codec.decode(out, vocab).collect()
    assert Counter((r.doc_id, r.decoded) for r in again) == Counter((r[0], r[2]) for r in rows.elements())
    assert bpe_codec.encode(docs.limit(0), vocab).count() == 0
    assert bpe_codec.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), vocab).first().decoded == ""


def test_token_files(spark, library):
    docs = spark.createDataFrame(documents(), COLUMNS)
    folder, manifest = token_files.write(docs, P.path("byte_bpe_50k.json"), end_id=0)
    out = token_files.read(folder, manifest, docs.schema["doc_id"].dataType, with_ids=True).collect()
    out.sort(key=lambda r: r.start)
    want = Counter()
    for r in documents():
        packed = np.array(library["byte"].encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want[(r[0], len(packed) // 4, zlib.crc32(packed), packed)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in out) == want
    keys = [-1 if r.doc_id is None else r.doc_id for r in out]
    assert keys == sorted(keys)
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out]).tolist()[:-1]]


def test_readers_open_only_wanted_frames_and_notice_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(9)], "doc_id long, text string").coalesce(1)
    folder, manifest = token_files.write(docs, P.path("byte_bpe_50k.json"), end_id=0, folder=f"file://{tmp_path}/t")
    name = manifest.where("n_docs > 0").first()["name"]
    with open_file(folder, name) as f:
        reader = token_files.Reader(f)
        some = reader.ids.to_pylist()[1]
        read = []
        whole = reader.frame
        reader.frame = lambda i: read.append(i) or whole(i)
        assert [d for d, _ in reader.find([some])] == [some] and read == [1]
        at = reader.starts[1]
    path = tmp_path / "t" / name
    damaged = bytearray(path.read_bytes())
    damaged[at + 9] ^= 0xFF
    path.write_bytes(damaged)
    with open_file(folder, name) as f, pytest.raises(Exception):
        token_files.Reader(f).frame(1)


def test_token_files_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder, manifest = token_files.write(docs, P.path("byte_bpe_50k.json"), end_id=0)
    assert token_files.read(folder, manifest, docs.schema["doc_id"].dataType).count() == 0


def test_digest_columns_of_the_queries(spark, library, tmp_path):
    from lexmill.llm import queries

    spark.createDataFrame(documents(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, queries.QUERIES["op4_bpe_codec"](spark, str(tmp_path)).collect()))
    want = Counter()
    for r in documents():
        ids = library["word"].encode(r[1] or "", add_special_tokens=False).ids
        text = library["word"].decode(ids, skip_special_tokens=False)
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want


def test_every_code_point_is_encoded_as_the_library_does():
    """In three contexts each; letters that only newer Unicode versions know included."""
    from array import array

    file = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    library.no_truncation()
    library.no_padding()
    codec = bpe.WordBpe(file)
    texts = [t for i in (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)) for t in (chr(i), f"a{chr(i)}b 1{chr(i)}2", f"X{chr(i)} {chr(i)}É!")]
    for lo in range(0, len(texts), 20_000):
        some = texts[lo : lo + 20_000]
        for text, want in zip(some, library.encode_batch(some, add_special_tokens=False)):
            got = array("I")
            got.frombytes(codec.encode(text))
            assert list(got) == want.ids, ascii(text)
