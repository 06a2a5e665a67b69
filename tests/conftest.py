import json
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from ingot.session import REQUIRED_CONF  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    b = (
        SparkSession.builder.master("local[4]")
        .appName("ingot-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in REQUIRED_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ingot-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_root(tmp_path):
    return str(tmp_path)


def bronze_records(spark, records, batch=0):
    """Parsed bronze rows (record_v, _seq) in list order; dict -> JSON, str kept as is."""
    rows = [(json.dumps(r) if not isinstance(r, str) else r, i) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "record string, pos long")
    return df.select(
        F.try_parse_json("record").alias("record_v"),
        F.struct(
            F.lit(batch).cast("long").alias("_batch_id"),
            F.lit("").alias("_file"),
            F.lit(0).cast("long").alias("_block"),
            F.col("pos").alias("_pos"),
        ).alias("_seq"),
    )


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
