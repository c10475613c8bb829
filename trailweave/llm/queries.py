"""The registered queries of the subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .chat_format import REPLY, format_chats, turns_as_calls
from .common import table
from .decontaminate import match_items
from .exact_dedup import content_sort_dedup
from .langid import learn_and_identify
from .licenses import scan_licenses
from .near_dedup import minhash_dedup
from .packing import pack
from .suffix_dedup import suffix_dedup
from .toxicity import train_and_score


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_identify(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(turns_as_calls(table(spark, sf_dir, "conversations")), REPLY).drop("call_turn")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.transform("hits", lambda h: h["item"])
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("item_ids"), F.array_min(F.transform("hits", lambda h: h["distance"])).alias("least_distance"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("spans")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), percent=85).withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # read where it is used, so that a missing vocabulary takes no other query along

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content_sort_dedup(table(spark, sf_dir, "documents"), keep="max")
    return found.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_tool_call_linking, op4_decontamination, op5_suffix_array_dedup, op6_minhash_near_dedup, op7_toxicity, op8_warc_derivatives, op9_best_fit_packing, op10_exact_dedup)}

SQL: dict[str, str] = {
    "op3_tool_call_linking": """
        WITH RECURSIVE m AS (
            SELECT conv_id, turn, role, text, length(text) AS n, role IN ('user', 'assistant') AS calls,
                   CASE WHEN role = 'assistant' OR role = 'user' AND turn % 4 IN (2, 3) THEN CASE WHEN conv_id % 2 = 0 THEN turn - 1 ELSE turn + 1 END END AS answered,
                   CASE WHEN length(text) % 7 = 0 THEN 'erase' ELSE 'reply' END AS tool
            FROM conversations
        ), walk AS (
            SELECT conv_id, turn, turn AS top, 1 AS links FROM m
            WHERE calls AND NOT EXISTS (SELECT 1 FROM m p WHERE p.calls AND p.conv_id = m.conv_id AND p.turn = m.answered)
            UNION ALL
            SELECT m.conv_id, m.turn, greatest(m.turn, w.top), w.links + 1 FROM m JOIN walk w ON m.conv_id = w.conv_id AND m.answered = w.turn WHERE m.calls
        ), held AS (
            SELECT m.*, w.top, w.links,
                   CASE n % 11 WHEN 0 THEN '"{\\"n_chars\\":"' WHEN 1 THEN '{"turn":' || m.turn || '}' WHEN 2 THEN '{"n_chars":"many","turn":' || m.turn || '}'
                        WHEN 3 THEN '{"n_chars":' || n || ',"style":"loud","turn":' || m.turn || '}' WHEN 4 THEN '{"n_chars":-' || n || ',"turn":' || m.turn || '}'
                        ELSE '{"n_chars":' || n || ',"style":"plain","turn":' || m.turn || '}' END AS arguments,
                   CASE WHEN tool = 'erase' THEN CASE WHEN n % 11 = 0 THEN ['not JSON', 'unknown tool'] ELSE ['unknown tool'] END
                        ELSE CASE n % 11 WHEN 0 THEN ['not JSON'] WHEN 1 THEN ['n_chars: missing'] WHEN 2 THEN ['n_chars: not integer'] WHEN 3 THEN ['style: not listed'] WHEN 4 THEN ['n_chars: under 1'] ELSE []::VARCHAR[] END END AS wrong
            FROM m LEFT JOIN walk w ON m.conv_id = w.conv_id AND m.answered = w.turn
        )
        SELECT conv_id, turn, role, answered::VARCHAR AS call_id, answered IS NOT NULL AND links IS NULL AS orphan, greatest(turn, top) AS anchor, coalesce(links, 0)::INTEGER AS depth,
               CASE WHEN calls THEN array_to_string(list_transform(wrong, lambda x: turn || ': ' || x), '; ') ELSE '' END AS errors,
               '{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '"' || CASE WHEN answered IS NOT NULL THEN ',"tool_call_id":"' || answered || '"' ELSE '' END
                   || CASE WHEN calls THEN ',"tool_calls":[{"arguments":' || arguments || ',"id":"' || turn || '","name":"' || tool || '"}]' ELSE '' END || ',"turn":' || turn || '}' AS json
        FROM held
    """,
    "op8_warc_derivatives": warc.oracle_sql(),
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
