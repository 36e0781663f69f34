"""The queries ``opN_<name>`` and ``pipeline`` over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codec, licenses, media, neardup, packing, substrings, tokens, topk, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_features(table(spark, sf_dir, "documents"))
    return rows.withColumn("feature", F.lower(F.hex("cosine_hash"))).drop("cosine_hash", "intact")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), limit=2048, chunk=1 << 13)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("places")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE), capacity=1024, tail=(2,))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP3_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         list([role, text] ORDER BY turn NULLS FIRST, role, text) AS body,
         count(*) FILTER (WHERE role = 'user') AS n_user,
         count(*) FILTER (WHERE role = 'assistant') AS n_assistant,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, role, text) AS chat
  FROM turns GROUP BY conv_id),
kept AS (
  SELECT body, n_turns, any_value(n_user) AS n_user, any_value(n_assistant) AS n_assistant, any_value(chat) AS chat,
         count(*) AS n_copies,
         CASE WHEN count(*) = count(conv_id) THEN min(conv_id) END AS conv_id
  FROM whole GROUP BY body, n_turns),
inner_prefixes AS (
  SELECT DISTINCT body[1:i] AS body FROM (SELECT body, unnest(range(1, n_turns)) AS i FROM kept))
SELECT conv_id, n_turns, n_copies, length(chat) AS n_chars, n_user, n_assistant, chat
FROM kept ANTI JOIN inner_prefixes USING (body)
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_chat_collapse": op3_chat_collapse,
    "op4_media_columns": op4_media_columns,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_token_counts": op6_token_counts,
    "op7_exact_topk": op7_exact_topk,
    "op8_license_scan": op8_license_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_collapse": OP3_SQL,
    "op7_exact_topk": OP7_SQL,
    "op8_license_scan": licenses.oracle_sql(),
}
