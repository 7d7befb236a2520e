"""The queries op1 to op10 over the driver tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, best_fit_packing, exact_topk, html_main_text, minhash_dedup, quality_rules, text_sketch, toxicity, unigram_pieces, warc_archive

Query = Callable[[SparkSession, str], DataFrame]


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = minhash_dedup.near_duplicates(docs, minhash_dedup.Policy(shingle=3, percent=85))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def vocabulary(name: str) -> str:
    """Where a file of a public tokenizer is; looked up when a query runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return best_fit_packing.packed(docs, vocabulary("word_bpe_49k.json"), 2048)


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return _predicted(toxicity.scored(docs, labels, (3, 1)), 0.7)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return _predicted(quality_rules.scored(docs, labels, (5, 0)), 0.3)


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_archive.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0)
    return found.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op3_text_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sketch.fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_lm.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), (7, 2))
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op7_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_pieces.encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op5_exact_topk": op5_exact_topk,
    "op6_backoff_lm": op6_backoff_lm,
    "op7_unigram_pieces": op7_unigram_pieces,
    "op1_warc_archive": op1_warc_archive,
    "op3_text_sketch": op3_text_sketch,
    "op9_html_main_text": op9_html_main_text,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op2_minhash_dedup": op2_minhash_dedup,
}

ORACLES: dict[str, str] = {
    "op5_exact_topk": r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op6_backoff_lm": r"""
WITH t AS (
  SELECT doc_id, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' end ') AS ws,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 7 = 2 AS held_out
  FROM documents
), k AS (SELECT doc_id, held_out, unnest(ws) AS w, unnest(list_prepend(' end ', ws[:len(ws) - 1])) AS v FROM t
), uni AS (SELECT w, count(*) AS c FROM k WHERE NOT held_out GROUP BY w
), bi AS (SELECT v, w, count(*) AS c FROM k WHERE NOT held_out GROUP BY v, w
), n AS (SELECT CAST(sum(c) AS BIGINT) AS train_tokens, count(*) AS vocabulary FROM uni
), x AS (
  SELECT doc_id, held_out, train_tokens, coalesce(a.c, 0) AS cw, coalesce(b.c, 0) AS cv, coalesce(bi.c, 0) AS cvw, (coalesce(a.c, 0) + 1.0) / (train_tokens + vocabulary + 1.0) AS p
  FROM k CROSS JOIN n LEFT JOIN uni a ON a.w = k.w LEFT JOIN uni b ON b.w = k.v LEFT JOIN bi ON bi.v = k.v AND bi.w = k.w
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (cw > 0) AS n_known, any_value(train_tokens) AS train_tokens, round(sum(log10(CAST(p AS DOUBLE))), 6) AS base_score,
  round(sum(log10(CASE WHEN cv = 0 THEN CAST(p AS DOUBLE) ELSE (cvw + 500 * CAST(p AS DOUBLE)) / (cv + 500) END)), 6) AS score
FROM x GROUP BY doc_id, held_out
""",
    "op1_warc_archive": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, upper(sha1(coalesce(html, ''))) AS h FROM pages
), d AS (
  SELECT page_id, body, min(page_id) OVER (PARTITION BY body) AS least, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(1 + 10 * (k // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > least THEN least END AS refers_to FROM d
""",
    "op2_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
""",
}
