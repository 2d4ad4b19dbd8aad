"""The dealt operators as named queries over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, language_id, merkle, mixing, ngram_join, resampling, simhash, token_counts, token_files, url_filters, vector_search, warc, winnowing
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_bpe_codec")
def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codec encodes and then decodes its own ids; the digests are taken of both."""
    vocab = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe_codec.encode(read_table(spark, sf_dir, "documents"), vocab)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder, manifest = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read(folder, manifest, docs.schema["doc_id"].dataType)


#: The rules that the contract fixes.
URL_RULES = [
    url_filters.Rule("com", "/", "allow"),
    url_filters.Rule("example.com", "/en/", "block"),
    url_filters.Rule("www.example.com", "/en/", "allow"),
    url_filters.Rule("net", "/es/", "block"),
    url_filters.Rule("net", "/fr/", "block"),
]

_URL_SQL = r"""
WITH RECURSIVE parsed AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
nodes AS (
  SELECT page_id, host, path, html, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS origin,
         translate(regexp_extract(regexp_replace(trim(url), '#.*$', '', 's'), '^(.*?://[^/?]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
           || substr(regexp_replace(trim(url), '#.*$', '', 's'), length(regexp_extract(regexp_replace(trim(url), '#.*$', '', 's'), '^(.*?://[^/?]*)', 1, 's')) + 1) AS node
  FROM parsed),
targets AS (
  SELECT node, origin, regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is') AS target FROM nodes
  UNION ALL
  SELECT node, origin, regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is') FROM nodes),
linked AS (
  SELECT node AS a, regexp_replace(CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN split_part(origin, '//', 1) || target
         WHEN starts_with(target, '/') THEN origin || target END, '#.*$', '', 's') AS b
  FROM targets WHERE target <> ''),
edges AS (SELECT a, b FROM linked WHERE b IS NOT NULL UNION SELECT b, a FROM linked WHERE b IS NOT NULL),
reach(node, other) AS (SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
known AS (
  SELECT DISTINCT other, translate(regexp_extract(other, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(other, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM reach),
decided AS (
  SELECT k.other, arg_max(r.r_verdict, length(r.r_host || r.r_path)) AS verdict
  FROM known k JOIN rules r ON (k.host = r.r_host OR ends_with(k.host, '.' || r.r_host)) AND starts_with(k.path, r.r_path) GROUP BY k.other),
shared AS (
  SELECT r.node, CASE WHEN bool_or(d.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM (SELECT node, other FROM reach UNION SELECT node, node FROM reach) r JOIN decided d ON d.other = r.other GROUP BY r.node),
own AS (
  SELECT n.page_id, arg_max(r.r_host || r.r_path, length(r.r_host || r.r_path)) AS rule, arg_max(r.r_verdict, length(r.r_host || r.r_path)) AS verdict
  FROM nodes n JOIN rules r ON (n.host = r.r_host OR ends_with(n.host, '.' || r.r_host)) AND starts_with(n.path, r.r_path) GROUP BY n.page_id)
SELECT n.page_id, n.host, n.path, o.rule, coalesce(o.verdict, s.verdict, 'allow') AS verdict
FROM nodes n LEFT JOIN own o ON o.page_id = n.page_id LEFT JOIN shared s ON s.node = n.node
"""


@query("op6_url_filters", _URL_SQL)
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


@query("op9_winnowing")
def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.with_neighbours(read_table(spark, sf_dir, "documents"))


_EDITED_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
paired AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM texts)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(following, 1, length(t) // 2)) AS edited_sha256 FROM paired
"""


@query("edited_texts", _EDITED_SQL)
def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9 SQL can say: sizes and edited texts."""
    return op9_winnowing(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


_WARC_SQL = """
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
sized AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest, sha256(body) AS same FROM bodies),
kept AS (SELECT same, max(page_id) AS keeper FROM sized WHERE payload_bytes >= 1000 GROUP BY same)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM sized LEFT JOIN kept ON kept.same = sized.same AND payload_bytes >= 1000
"""


@query("op5_warc", _WARC_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write(read_table(spark, sf_dir, "pages"))
    return warc.read(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Weights that sources take in turn, what the mix holds of all words, and the most of one source.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [3, 1, 2], 1.5, 2.0


@query("op1_source_mix")
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mixing.mix_plan(docs, MIX_WEIGHTS, share=MIX_SHARE, most=MIX_MOST)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d.shard).alias("shards"))


# Shares by weight, what is above a cap fixed at it, and the rest shared again until nothing is above.
_TARGETS_SQL = rf"""
WITH RECURSIVE sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
listed AS (SELECT list({{'place': place, 'size': source_size, 'weight': ([3, 1, 2])[(place - 1) % 3 + 1]}}) AS s FROM sources),
levels(fixed, level, over) AS (
  SELECT []::BIGINT[], 0.0::DOUBLE, [0]::BIGINT[]
  UNION ALL
  SELECT fixed, level, list_transform(list_filter(s, lambda x: NOT list_contains(fixed, x.place) AND level * x.weight > 2 * x.size), lambda x: x.place) FROM (
    SELECT fixed, s, (1.5 * list_sum(list_transform(s, lambda x: x.size)) - coalesce(list_sum(list_transform(list_filter(s, lambda x: list_contains(fixed, x.place)), lambda x: 2 * x.size)), 0))
           / list_sum(list_transform(list_filter(s, lambda x: NOT list_contains(fixed, x.place)), lambda x: x.weight)) AS level
    FROM (SELECT list_distinct(fixed || over) AS fixed FROM levels WHERE len(over) > 0), listed WHERE len(list_filter(s, lambda x: NOT list_contains(fixed, x.place))) > 0)),
final AS (SELECT fixed, level FROM levels WHERE len(over) = 0)
SELECT doc_id, size, source_size, round(CASE WHEN list_contains(fixed, place) THEN 2.0 * source_size ELSE level * ([3, 1, 2])[(place - 1) % 3 + 1] END, 6) AS target
FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source, final
"""


@query("mix_targets", _TARGETS_SQL)
def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op1 SQL can say: sizes and targets."""
    return op1_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


@query("op8_vector_search")
def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return vector_search.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def held_out(doc_id="doc_id"):
    """The fold that language identification never learns from; rows without an id can be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = language_id.train(docs.where(~held_out()))
    return language_id.predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


_JOIN_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM worded),
sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id)) AS component_id
FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id
"""


@query("op10_ngram_join", _JOIN_SQL)
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


# CRC-32 bit by bit: each byte is followed by seven zeros, and each step shifts one bit out.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length({0}) // 2), lambda i: [('0x' || substr({0}, (2 * i + 1)::INT, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
         lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""

_RESAMPLE_SQL = rf"""
WITH read AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
held AS (SELECT doc_id, unnest(w) AS f FROM read),
words AS (SELECT f, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t, hex(encode(f)) AS h FROM (SELECT f, 1 AS s, 0 AS t FROM held UNION ALL SELECT f, 0, 1 FROM wanted) GROUP BY f),
coded AS (SELECT f, s, t, {_CRC.format('h')} % 10000 AS bucket FROM words),
gains AS (
  SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM words)::DOUBLE / ((sum(s) + 1)::DOUBLE * (SELECT sum(t) + 10000 FROM words)::DOUBLE)))::BIGINT AS gain FROM coded GROUP BY bucket),
weighed AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM held JOIN coded USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM read LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranked r USING (doc_id)
"""


@query("op11_resampling", _RESAMPLE_SQL)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, seed=42, bits=3)


_FIELDS = "concat(" + ", ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "{0}", "text")) + ")"
_MERKLE_SQL = f"""
WITH RECURSIVE coded AS (SELECT *, hex(encode(doc_id::VARCHAR)) AS h FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256({_FIELDS.format('n_chars::VARCHAR')}) AS leaf, sha256({_FIELDS.format('(n_chars + 1)::VARCHAR')}) AS changed, {_CRC.format('h')} % 7 = 0 AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM coded),
tree(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY place) FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM tree WHERE len(nodes) = 1),
upper(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM upper WHERE len(nodes) > 1),
beside AS (
  SELECT doc_id, level, ((l.place >> level) & 1) AS odd, coalesce(nodes[xor(l.place >> level, 1) + 1], '') AS other FROM leaves l JOIN tree t ON l.lang IS NOT DISTINCT FROM t.lang AND len(nodes) > 1
  UNION ALL
  SELECT doc_id, 1000 + level, ((s.place >> level) & 1), coalesce(nodes[xor(s.place >> level, 1) + 1], '') FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, upper WHERE len(nodes) > 1),
paths AS (SELECT doc_id, list(odd || other ORDER BY level) AS path FROM beside GROUP BY doc_id),
folded AS (
  SELECT l.doc_id, leaf, subroot, (SELECT nodes[1] FROM upper WHERE len(nodes) = 1) AS root, sha256(list_reduce(list_prepend('', coalesce(path, [])), lambda a, x: a || substr(x, 2))) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN tampered AND n_chars IS NOT NULL THEN changed ELSE leaf END, coalesce(path, [])), lambda a, x: sha256(CASE WHEN x[1] = '1' THEN substr(x, 2) || a ELSE a || substr(x, 2) END)) AS folded_root
  FROM leaves l JOIN documents d USING (doc_id) JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths p ON p.doc_id = l.doc_id)
SELECT *, folded_root = root AS verified FROM folded
"""


@query("op13_merkle", _MERKLE_SQL)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and whether each row, some of them tampered with, still leads to the root."""
    docs = read_table(spark, sf_dir, "documents")
    col = lambda name: F.col(name)
    whole = merkle.leaf(*map(col, ("doc_id", "source", "lang", "n_chars", "text")))
    one_more = F.col("n_chars").cast("decimal(38,0)") + 1
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = F.when(tampered, merkle.leaf(col("doc_id"), col("source"), col("lang"), one_more, col("text")))
    made = merkle.manifest(docs, whole, keep={"changed": changed})
    out = made.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("path"))).alias("proof_sha256"), merkle.fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module for the shared parameters

    return corpus_pipeline.run(spark, sf_dir)
