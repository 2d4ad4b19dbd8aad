"""Token counts by heap-and-linked-list byte-pair merging; no ids are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_batch, map_batches, struct, texts_of


def count_tokens(docs: DataFrame, model_file: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    Every whole text is counted as the sentencepiece library does for ``model_file``,
    without begin, end or added tokens. A null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows are counted each; a null id is passed through; other columns of
    ``docs`` are not read, whatever their names; an empty table gives no rows. Very
    long texts are merged in n log n steps and never cut short. Narrow: no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = struct(id=rows.schema["id"].dataType, n_bytes="long", n_tokens="long")

    def count(batch):
        counter = bpe.piece_counter(model_file)
        texts = texts_of(batch, "text")
        yield arrow_batch(schema, {"id": batch.column("id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [counter.count(t) for t in texts]})

    return map_batches(rows, count, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
