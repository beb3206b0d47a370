"""The thin queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann_lists, bpe, crf_toxicity, elias_fano, lang_bloom, license_scan, mixing, mpegts, prefix_join, warc
from .common import table

RANKS, TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def op1_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_bloom.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), RANKS, public_tokenizers.PATTERN)


def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_toxicity.toxicity(spark, sf_dir)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elias_fano.token_files(table(spark, sf_dir, "documents", "doc_id", "text"), TOKENIZER)


def op5_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_lists.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_files(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.media_features(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_filters, op2_byte_bpe, op3_toxicity_crf, op4_token_files, op5_prefix_join, op6_posting_lists, op7_warc, op8_license_index, op9_mpeg_ts, op10_mixing)}
#: Base32 of a digest is five bits for each character.
ORACLES: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS INT), 1)), '') AS payload_digest,
            CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to
        FROM d"""
}
