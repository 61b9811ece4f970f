"""The registered queries of the corpus operators: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, langid, licenses, media, mixing, near_dedup, phrases, repair, secrets, sharding, templates, topk
from .sql import ORACLES


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), width=2)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.chat_report(rows.unionByName(extra))


def op6_shard_by_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_curve(_documents(spark, sf_dir))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_documents(spark, sf_dir))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(_documents(spark, sf_dir))


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_documents(spark, sf_dir))


def op11_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


def op13_repair_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secret_scans, op2_minhash_near_dedup, op3_exact_top_k, op4_mix_sources, op5_chat_format,
        op6_shard_by_curve, op7_license_scans, op8_media_columns, op9_byte_level_bpe, op10_language_id, op11_extract_text,
        op12_phrase_collocations, op13_repair_structure,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
