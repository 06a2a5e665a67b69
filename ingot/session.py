"""Session settings the library relies on.

Every public entry point calls :func:`configure` so that queries behave the
same whether the caller built the session or we did. Only runtime-settable SQL
confs are touched; cluster sizing stays with whoever launched the cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the semantics depend on (fixed values).
REQUIRED_CONF = {
    # timestamps are compared with an oracle that is UTC-naive
    "spark.sql.session.timeZone": "UTC",
    # key injection: {"league_id": L, **payload} -> the payload's value wins
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # duplicate JSON object keys: the last one wins, as in Python's json module
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings for plan quality; safe to override from outside.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM leaves methods of more than 8000 bytes uncompiled: a stage whose one method is larger runs several times faster
    # operator by operator, where Spark cuts the methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the semantics depend on; keep caller overrides of the rest."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


_FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Sizes for records and their keys, which compress some twenty times: with Spark's 64 and 128 MB a task sorts over a gigabyte.
_TASK_CONF = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "32m"}


def at_least_partitions(spark: SparkSession, count: int) -> None:
    """Let a shuffle begin with ``count`` partitions or more; adaptive execution puts small ones together, up to a size.

    With a fixed number, or that size too large, what a task sorts grows with the input until it spills. Sizes that the caller set stay.
    """
    least = max(count, int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(_FIRST_PARTITIONS, None) or 0))
    spark.conf.set(_FIRST_PARTITIONS, str(least))
    for k, v in _TASK_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For a job of many steps: the shuffle files of a plan that is made within are deleted as soon as it has run.

    Otherwise they lie there until the driver's collector finds the plan, which may take half an hour: those of all steps at once.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "ingot") -> SparkSession:
    """Local session for tests and the bench; a cluster job passes its own session."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("INGOT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**REQUIRED_CONF, **DEFAULT_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialised intermediate data: what ``spark.checkpoint.dir`` names.

    Where it is unset, a session whose tasks all run in the driver's process
    (local tests, the bench) gets a folder of its own; a cluster session is
    refused, because its executors would not see a folder of one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="ingot-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique directory name under the checkpoint root (not created)."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/ingot-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows, written once to the shared checkpoint folder and read back: later steps neither repeat
    the work nor depend on shuffle files of lost executors, and the planner knows their size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
