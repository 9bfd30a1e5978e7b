"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_tree, chat, exact_dedup, langid, merges, packing, passages, pii, simhash, token_files
from .tokens import public


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(_documents(spark, sf_dir))


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.encode(_documents(spark, sf_dir), public("piece_bpe_32k.model"), rate=0.1, seed=1)


#: The tool that turns_as_calls makes of a conversation's turns.
ANSWER = {"answer": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), ANSWER)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20, scale=64.0)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(_documents(spark, sf_dir), public("byte_bpe_50k.json"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public("word_bpe_49k.json"), capacity=2048)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_documents(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(_documents(spark, sf_dir), words=3, radius=2)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(_documents(spark, sf_dir), length=50)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_documents(spark, sf_dir), keep="largest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_merge_dropout": op2_merge_dropout,
    "op3_tool_call_linking": op3_tool_call_linking,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_token_files": op5_token_files,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_personal_data": op7_personal_data,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 20 = 0
        ), placed AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT * FROM placed WHERE rank <= 20
    """,
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
