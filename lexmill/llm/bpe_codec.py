"""BPE encoding to packed ids and decoding back to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_batch, map_batches, struct, texts_of


def encode(docs: DataFrame, vocab_file: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """``keep`` columns, ids (packed little-endian unsigned 32-bit integers) and decoded text.

    Encodes every whole text as the tokenizers library does for the word-level
    ``vocab_file`` without added special tokens; special strings inside a text become
    their ids. A null text is encoded as the empty text: no ids, empty decoded text.
    Repeated rows are encoded each; a column of ``keep`` named like an output is
    replaced by the output; other columns aren't read; an empty table gives no rows.
    Long texts are encoded whole. Narrow: no shuffle.
    """
    kept = [c for c in keep if c not in ("ids", "decoded")]
    rows = docs.select(*[F.col(c) for c in kept], F.col(text_col).alias("__text"))
    fields = {c: rows.schema[c].dataType for c in kept} | {"ids": "binary"} | ({"decoded": "string"} if with_text else {})
    schema = struct(**fields)

    def run(batch):
        codec = bpe.word_bpe(vocab_file)
        ids = [codec.encode(t) for t in texts_of(batch, "__text")]
        columns = {c: batch.column(c) for c in kept} | {"ids": ids} | ({"decoded": [codec.decode(x) for x in ids]} if with_text else {})
        yield arrow_batch(schema, columns)

    return map_batches(rows, run, schema)


def decode(rows: DataFrame, vocab_file: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the decoded text of packed ids: vocabulary strings with one space between.

    Null and empty ids decode to the empty text; ids outside the vocabulary are left out.
    Long id lists are decoded whole, repeated rows each; a column of ``keep`` named
    decoded is replaced by the output; other columns aren't read; an empty table gives no rows.
    """
    kept = [c for c in keep if c != "decoded"]
    source = rows.select(*[F.col(c) for c in kept], F.col(ids_col).alias("__ids"))
    schema = struct(**{c: source.schema[c].dataType for c in kept}, decoded="string")

    def run(batch):
        codec = bpe.word_bpe(vocab_file)
        yield arrow_batch(schema, {c: batch.column(c) for c in kept} | {"decoded": [codec.decode(x or b"") for x in batch.column("__ids").to_pylist()]})

    return map_batches(source, run, schema)
