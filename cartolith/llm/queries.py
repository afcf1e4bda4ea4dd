"""The registered queries of the training-data operators. Each one takes whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, fingerprints, line_dedup, packing, pii, quality, simhash, token_files, toxicity
from .common import documents


def _word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), _word_bpe(), capacity=2048, end_id=0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir), min_chars=20, min_docs=3)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(documents(spark, sf_dir))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digests(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), _word_bpe(), end_id=2)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_chat": op6_chat,
    "op7_fingerprints": op7_fingerprints,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_token_files": op10_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.SQL,
    "op6_chat": chat.SQL,
}
