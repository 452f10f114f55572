"""The operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from capsort.llm import decontam, langid, licenses, mixing, sharding, simhash, suffix_dedup, token_counts, topk, toxicity
from capsort.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_token_counts, op2_mix_sources, op3_simhash, op4_suffix_dedup, op5_license_scan, op6_toxicity, op7_sharding, op8_language_id, op9_decontamination, op10_exact_top_k]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


#: Both engines cut the components to whole numbers and add whole products, so scores agree exactly.
OP10_SQL = """
WITH usable AS (
  SELECT vec_id, LIST_TRANSFORM(embedding, LAMBDA x: CAST(FLOOR(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND LEN(LIST_FILTER(embedding, LAMBDA x: x IS NULL OR NOT ISFINITE(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(LIST_SUM(LIST_TRANSFORM(LIST_ZIP(q.v, c.v), LAMBDA p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND LEN(q.v) = LEN(c.v)),
ranked AS (
  SELECT query_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Words by position; windows of items joined to windows of documents; hit positions counted once.
OP9_SQL = """
WITH split AS (
  SELECT doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, ARRAY_TO_STRING(w[a : a + n - 1], ' ') AS gram
  FROM (SELECT item, w, LEAST(10, LEN(w)) AS n, UNNEST(RANGE(1, LEN(w) - LEAST(10, LEN(w)) + 2)) AS a FROM items WHERE LEN(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, a, ARRAY_TO_STRING(w[a : a + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, UNNEST(RANGE(1, LEN(w) - n + 2)) AS a FROM split, lengths WHERE LEN(w) >= n)),
found AS (SELECT doc_id, item, g.n, a FROM grams g JOIN windows USING (n, gram)),
hits AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, UNNEST(RANGE(a, a + n)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, COUNT(DISTINCT item) AS n_items, SHA256(STRING_AGG(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM found GROUP BY doc_id)
SELECT s.doc_id, CAST(LEN(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, COALESCE(items_sha256, SHA256('')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {"op2_mix_sources": mixing.ORACLE_SQL, "op9_decontamination": OP9_SQL, "op10_exact_top_k": OP10_SQL} | pipeline
