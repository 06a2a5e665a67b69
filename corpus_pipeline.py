"""The training-data pipeline: quality rules, near-dedup, PII, source mix, SentencePiece.

Each stage is a function of (spark, docs, sf_dir); ``run`` applies them to
``documents`` in order, writing each result as Parquet in the shared folder and reading it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ingot.llm.common import materialise, prepare, read
from ingot.llm.minhash import drop_near_duplicates
from ingot.llm.mixing import mix
from ingot.llm.pieces import encode_documents
from ingot.llm.pii import redact
from ingot.llm.quality import filter_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; boilerplate lines leave the others."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and decoded of each document of the mix."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

# Shingle sketches, the trained span classifier and SentencePiece are beyond SQL: tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
