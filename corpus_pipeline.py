"""A corpus pipeline over the documents table, built from the training-data operators.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but
the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe_codec, language_id, mixing, ngram_join
from lexmill.llm.common import measured, store
from lexmill.llm.queries import MIX_MOST, MIX_SHARE, MIX_WEIGHTS

#: The language of a text is accepted from this mean probability on.
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose text has a recognised language.

    The network learns from the labelled rows of its own input. Rows go if the text is
    null or has no letter (``und``), or if no language reaches LEAST_SCORE; where no row
    has a label nothing can be recognised and only ``und`` by its text goes. Rows and
    columns are otherwise unchanged, repeated rows included.
    """
    columns = docs.columns
    net = language_id.train(docs)
    if net is None:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), docs["text"].alias("text"))
    judged = language_id.predict(whole, net, keep=("doc",))
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingles at similarity 0.8 join, keep the smallest doc_id.

    Rows are judged by id and text, so an id with several texts keeps those that stay; of
    rows equal in both one stays. Rows with a null id take no part in links and stay; null,
    empty and wordless texts link with nothing, so of each id one such row stays. Whole texts
    of any length are compared; all columns, of any name, are kept; an empty table gives no rows.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("tag"))
    linked = ngram_join.link(docs.select("doc_id", "text"), words=5, num=80, den=100, tag=F.xxhash64("text"))
    pair = [F.col("doc_id").alias("id"), "tag"]
    gone = store(linked.where("component_id <> doc_id").select(*pair).distinct(), "pipeline-gone")
    kept = whole.join(measured(gone), ["id", "tag"], "left_anti")
    again = store(linked.where("doc_id is not null").groupBy("doc_id", "tag").count().where("count > 1").select(*pair), "pipeline-repeated")
    if not again.take(1):
        return kept.select("doc.*")
    again = measured(again)
    once = kept.join(again, ["id", "tag"], "left_anti")
    several = kept.join(again, ["id", "tag"], "left_semi").dropDuplicates(["id", "tag"])
    return once.unionByName(several).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row as often as the mix takes it, dealt out by output shard.

    Null and empty texts have size 0 and come with their block; rows with a null source
    are a source of their own; repeated rows share their fate; all columns, of any name, are
    kept; an empty table gives no rows.
    """
    return mixing.mix(docs, MIX_WEIGHTS, share=MIX_SHARE, most=MIX_MOST)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed little-endian unsigned 32-bit integers) and the decoded text.

    A null text is empty: no ids, the empty text. Whole texts of any length, repeated rows
    each; other columns aren't read; an empty table gives no rows.
    """
    coded = bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", keep_one_of_each_group),
    ("source_mix", mix_sources),
    ("bpe_codec", encode_tokens),
]

#: The learned language filter and the hashed draws of the mix can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, f"pipeline-{name}")
    return docs
