"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, lexical, mixing, ngram_join, packing, quality, rules, substring, suffix, toxicity, warc, whiten
from .common import crc_mod, shared_dir, table, text_column


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(modulus: int, remainder: int) -> Column:
    """A null doc_id is not held out."""
    return F.coalesce(crc_mod("doc_id", modulus) == remainder, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.scored(docs, toxicity.fit(docs, labels, "toxic", ~held_out(5, 0)))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, "quality", ~held_out(3, 1))
    found = quality.with_score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digests(chat.chat_segments(rows)).drop("error")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents")).drop("lang")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*first, *[c for c in found.columns if c not in first])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(text_column()).alias("size"))
    return mixing.taken_words(mixing.written(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("_kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/files/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), root)
    return warc.read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(table(spark, sf_dir, "embeddings"), k=4)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_classifier, op3_ngram_join, op4_chat_formatting, op5_packing, op6_quality_rules, op7_source_mixing, op8_nearest_vectors, op9_suffix_array_dedup, op10_substring_dedup, op11_warc, op12_lexical_search, op13_embedding_whitening)}

OP4 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 17 ELSE 16 + length(role) END
  + list_sum(list_transform(['<s>', '</s>', '[SYS]', '[/SYS]', '[INST]', '[/INST]', '[ANS]', '[/ANS]', '[ROLE', '[/ROLE]'], lambda x: (length(text) - length(replace(text, x, ''))) // length(x))) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role || ',', '' ORDER BY turn NULLS FIRST, role, text), '(system,)?user,(assistant,user,)*(assistant,)?|system,') AS valid
FROM f GROUP BY conv_id"""

OP7 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, sum(size) AS source_size, count(*) AS n FROM d GROUP BY source),
s1 AS (SELECT *, list_extract([5e0, 2e0, 1e0], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight, source_size * 2e0 AS most, sum(source_size) OVER () * 15e-1 AS total FROM s0),
s2 AS (SELECT *, most / weight AS reach, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM s1),
s3 AS (SELECT *, max(here) FILTER (WHERE here <= reach) OVER () AS level FROM s2),
s4 AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, greatest(1, CAST(ceil(n / 8192e0) AS BIGINT)) AS shards, CASE WHEN source_size = 0 THEN 0e0 ELSE least(most, coalesce(level * weight, most)) END AS target, most FROM s3),
s AS (SELECT *, target >= most AS is_full, CAST(round(sum(target) OVER () / block) AS BIGINT) AS blocks, count(*) FILTER (WHERE target > 0) OVER () AS rivals FROM (SELECT *, CAST(greatest(1, coalesce(min(floor(target / (256 * shards))) FILTER (WHERE target > 0) OVER (), 1)) AS BIGINT) AS block FROM s4)),
q1 AS (SELECT source, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS place FROM (SELECT *, unnest(range(CAST(ceil(blocks * target / whole) + rivals AS BIGINT))) AS k FROM (SELECT *, sum(target) OVER () AS whole FROM s) WHERE target > 0)) WHERE place <= blocks GROUP BY source),
k AS (SELECT d.*, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size) AS key FROM d),
p AS (SELECT k.*, s.source_size, s.target, s.block, s.is_full, CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source),
u AS (SELECT p.source, shard, sum(size) AS unit_size, coalesce(any_value(quota), 0) AS seats, count(*) OVER (PARTITION BY p.source) AS rivals FROM p LEFT JOIN q1 ON p.source IS NOT DISTINCT FROM q1.source GROUP BY p.source, shard),
q2 AS (SELECT source, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY unit_size / CAST(2 * k + 1 AS DOUBLE) DESC, shard) AS place FROM (SELECT *, unnest(range(CAST(ceil(seats * unit_size / CAST(whole AS DOUBLE)) + rivals AS BIGINT))) AS k FROM (SELECT *, sum(unit_size) OVER (PARTITION BY source) AS whole FROM u) WHERE unit_size > 0)) WHERE place <= seats GROUP BY source, shard),
t AS (SELECT p.*, unit_size, CASE WHEN is_full THEN 2 * unit_size ELSE least(coalesce(quota, 0) * block, 2 * unit_size) END AS words, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS start
  FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source AND p.shard = u.shard LEFT JOIN q2 ON p.source IS NOT DISTINCT FROM q2.source AND p.shard = q2.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN unit_size > 0 THEN words // unit_size ELSE 0 END * size + greatest(0, least(size, words - CASE WHEN unit_size > 0 THEN words // unit_size ELSE 0 END * unit_size - start)) AS BIGINT) AS taken FROM t"""

OP8 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0) WHERE rank <= 20"""

OP11 = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN place > 1 AND payload_bytes >= 100 THEN first END AS refers_to
FROM (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST) AS place, min(page_id) OVER (PARTITION BY h) AS first FROM (SELECT page_id, url, coalesce(html, '') AS h FROM pages))"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
size AS (SELECT place, doc_id, len(t) AS n FROM d WHERE len(t) > 0), whole AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
post AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(t) AS term FROM d) GROUP BY ALL),
i AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM post, whole GROUP BY term, n_docs),
s AS (SELECT item, item_id, place, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN post USING (term) JOIN size USING (place), whole GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""

ORACLES: dict[str, str] = {"op11_warc": OP11, "op12_lexical_search": OP12, "op4_chat_formatting": OP4, "op7_source_mixing": OP7, "op8_nearest_vectors": OP8}
