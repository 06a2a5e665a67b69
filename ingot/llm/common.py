"""Helpers the operators share: words, local bindings, tables, materialised steps."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingot.session import checkpoint_root, configure, scratch_path

# Fixed by the contracts: a word is a run of characters other than space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"

# Rows per Arrow batch sent to Python: long documents stay within an executor's memory.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings, and a checkpoint folder all executors share."""
    configure(spark)
    checkpoint_root(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def keyed(df: DataFrame, *key: Column) -> DataFrame:
    """The rows as one struct ``_row`` beside ``_k1``, ``_k2``, ...: no column name can clash."""
    return df.select(F.struct("*").alias("_row"), *[k.alias(f"_k{i}") for i, k in enumerate(key, 1)])


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows, written once to the shared checkpoint folder and read back.

    Later steps then neither repeat the work nor depend on shuffle files of lost
    executors, and the planner knows the size of what it joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ships(module: str) -> None:
    """Send this module's functions to executors whole, as they need not have the library installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
