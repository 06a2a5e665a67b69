"""The subpackage's registered queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ingot.llm.chat import formatted
from ingot.llm.common import read
from ingot.llm.html import extract_pages
from ingot.llm import bytepairs, merkle, mixing, negatives, sharding
from ingot.llm.minhash import near_duplicates
from ingot.llm.mtree import top_k
from ingot.llm.pieces import encode_documents
from ingot.llm.pii import find_pii
from ingot.llm.quality import ORACLE as ORACLE_QUALITY
from ingot.llm.quality import quality
from ingot.llm.warc import archived

SHINGLE = 2  # words; fixed by the contract of operator 7


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))


def op5_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=SHINGLE)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(read(spark, sf_dir, "conversations"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


def op11_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.encoded(read(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(read(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_sharding": op2_sharding,
        "op3_html": op3_html,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_mtree": op5_mtree,
        "op6_warc": op6_warc,
        "op7_minhash": op7_minhash,
        "op8_mixing": op8_mixing,
        "op9_chat": op9_chat,
        "op10_quality": op10_quality,
        "op11_bytepairs": op11_bytepairs,
        "op12_negatives": op12_negatives,
        "op13_merkle": op13_merkle,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op2_sharding": sharding.ORACLE, "op8_mixing": mixing.ORACLE, "op10_quality": ORACLE_QUALITY, "op13_merkle": merkle.ORACLE,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
