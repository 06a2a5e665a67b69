"""Pluggable sources.

A source is anything Spark can read. ``ingest_format`` takes a reader format
name plus options - ``parquet``, ``json``, ``csv``, a JDBC URL, or a custom
Python ``DataSource`` registered under its own name - and pours the rows into
bronze as JSON records without any pipeline change. ``ingest_dataframe`` does
the same for a DataFrame already in hand.

The registry maps source ids to readers so a source can be chosen by name at
run time; unknown names raise ``KeyError`` rather than returning None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ingot.sources import bronze

Reader = Callable[..., DataFrame]
_REGISTRY: dict[str, Reader] = {}


def ingest_dataframe(df: DataFrame, source_id: str, tbl: str = "events", batch_id: int | None = None) -> DataFrame:
    """Bronze rows for a DataFrame (one JSON record per row)."""
    return bronze.records_from_dataframe(df, source_id, tbl, batch_id)


def read_format(spark: SparkSession, fmt: str, path: str | list[str] | None = None, schema=None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**{k: str(v) for k, v in options.items()})
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path is not None else reader.load()


def ingest_format(
    spark: SparkSession,
    fmt: str,
    source_id: str,
    tbl: str,
    path: str | list[str] | None = None,
    schema=None,
    batch_id: int | None = None,
    **options,
) -> DataFrame:
    """``spark.read.format(fmt).options(**options).load(path)`` -> bronze rows."""
    return bronze.records_from_dataframe(read_format(spark, fmt, path, schema, **options), source_id, tbl, batch_id)


# --------------------------------------------------------------------------- registry
def register_source(source_id: str, reader: Reader) -> None:
    """Register a reader ``(spark, **kwargs) -> DataFrame`` under a source id."""
    _REGISTRY[source_id] = reader


def register_datasource(spark: SparkSession, cls) -> str:
    """Register a ``pyspark.sql.datasource.DataSource`` subclass; its name becomes a format. Its reader may take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(cls)
    name = cls.name()

    def reader(spark: SparkSession, **options) -> DataFrame:
        return read_format(spark, name, **options)

    register_source(name, reader)
    return name


def get_source(source_id: str) -> Reader:
    try:
        return _REGISTRY[source_id]
    except KeyError:
        raise KeyError(f"no source registered as {source_id!r}") from None


def registered_sources() -> list[str]:
    return sorted(_REGISTRY)


def ingest_source(spark: SparkSession, source_id: str, tbl: str, batch_id: int | None = None, **kwargs) -> DataFrame:
    """Read a registered source by id and return its bronze rows."""
    df = get_source(source_id)(spark, **kwargs)
    return bronze.records_from_dataframe(df, source_id, tbl, batch_id)
