"""The driver's TPC-H-style tables playing the reference's roles.

player = part, league = customer, roster = order, rostered players = the
parts on an order's line items. Raw player records come from ``lineitem``
(one dirty, duplicated record per line item), roster snapshots from
``lineitem`` joined to ``orders`` (one snapshot per order and ship date).

These DataFrames are *record DataFrames* with typed columns; pass
``column_fields(df.columns)`` as the field accessor to the silver functions.
The derivation is fixed so that the DuckDB oracles can state it in SQL.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingot.functions.expr import column_fields
from ingot.operators.dedup import SEQ
from ingot.plans import silver as sv
from ingot.sources import files

PART_BYTES = 8 << 20  # of a table's files, that one task of a join sorts (some 400,000 line items)

# Column derivations of the raw player records (fixed values, mirrored by the oracles).
PLAYER_FIELDS = (
    "player_id",
    "display_name",
    "name",
    "position",
    "team",
    "status",
    "injury_status",
    "age",
    "trending",
    "updated_at",
    "number",
)
ROSTER_FIELDS = ("league_id", "roster_id", "players")
LEAGUE_FIELDS = ("league_id", "name", "league_name")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, as scanned."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession, sf_dir: str) -> int:
    """How many parts a shuffle of line items and orders should have, so that what a task holds doesn't grow with the input."""
    size = sum(files.size(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")[0] for name in ("lineitem", "orders"))
    return max(spark.sparkContext.defaultParallelism, ceil(size / PART_BYTES))


def player_records(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """Raw player records, one per line item; sequence = (ship date, order, line, supplier).

    ``ordered``: in the sequence's order. The line items are sorted, which are smaller than the records made of them.
    """
    li = table(spark, sf_dir, "lineitem")
    if ordered:
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]
        li = li.repartitionByRange(partitions(spark, sf_dir), *order).sortWithinPartitions(*order)
    rf, ls, q, ln = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity"), F.col("l_linenumber")
    null_s = F.lit(None).cast("string")
    return li.select(
        F.col("l_partkey").alias("player_id"),
        F.when(rf == "N", F.lit("")).when(rf == "R", null_s).otherwise(F.concat(F.lit("P"), F.col("l_suppkey"))).alias("display_name"),
        F.concat(F.lit("L"), ln).alias("name"),
        rf.alias("position"),
        F.when(ls == "O", null_s).otherwise(F.concat(F.lit("T"), F.col("l_suppkey") % 32)).alias("team"),
        F.when(q < 10, "Active").when(q < 20, "").otherwise("Inactive").alias("status"),
        F.when(ln == 1, "Out").when(ln == 2, "").when(ln == 3, "Active").otherwise(null_s).alias("injury_status"),
        F.when(ln == 5, "n/a").otherwise(q.cast("int").cast("string")).alias("age"),
        F.when(ln == 6, F.lit(None).cast("double")).otherwise(F.col("l_discount")).alias("trending"),
        F.col("l_shipdate").alias("updated_at"),
        ln.alias("number"),
        F.struct(
            F.col("l_shipdate").alias("s1"),
            F.col("l_orderkey").alias("s2"),
            F.col("l_linenumber").alias("s3"),
            F.col("l_suppkey").alias("s4"),
        ).alias(SEQ),
    )


def roster_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster snapshots: one per (order, ship date), holding that day's parts.

    The join output is hash-partitioned on the order key, which already
    satisfies the grouping on (customer, order, ship date): one shuffle per
    input, none for the aggregate. A group holds one order's lines of one day.
    The partitions are as many as the input asks for, so that what a task sorts doesn't grow with it.
    """
    parts = partitions(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    snap = (
        li.repartition(parts, "l_orderkey").join(od.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_orderkey", "l_shipdate")
        .agg(F.collect_list(F.col("l_partkey").cast("string")).alias("players"))
    )
    return snap.select(
        F.col("o_custkey").alias("league_id"),
        F.col("l_orderkey").alias("roster_id"),
        "players",
        F.struct(F.col("l_shipdate").alias("s1")).alias(SEQ),
    )


def league_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """League records: a stale copy of every customer (old name under ``league_name``)
    followed by the current one (``name``). Latest wins must pick the current name."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    null_s = F.lit(None).cast("string")
    stale = c.select(
        F.col("c_custkey").alias("league_id"),
        null_s.alias("name"),
        F.concat(F.col("c_name"), F.lit(" (old)")).alias("league_name"),
        F.struct(F.lit(0).alias("s1")).alias(SEQ),
    )
    fresh = c.select(
        F.col("c_custkey").alias("league_id"),
        F.col("c_name").alias("name"),
        null_s.alias("league_name"),
        F.struct(F.lit(1).alias("s1")).alias(SEQ),
    )
    return stale.unionByName(fresh)


def matchup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matchup records: one per line item; its order is the roster, its line number the week, and the latest ship date is the last score."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("league_id"), F.col("l_linenumber").alias("week"),
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey") % 6).alias("matchup_id"), F.col("l_orderkey").alias("roster_id"),
        F.when(F.col("l_linenumber") != 5, F.col("l_quantity")).alias("points"),
        F.struct(F.col("l_shipdate").alias("s1"), F.col("l_partkey").alias("s2"), F.col("l_suppkey").alias("s3")).alias(SEQ),
    )


# --------------------------------------------------------------------------- silver over the roles
def silver_players(spark: SparkSession, sf_dir: str, method: str = "max_by") -> DataFrame:
    recs = player_records(spark, sf_dir)
    return sv.players(recs, column_fields(recs), method=method)


def silver_rosters(spark: SparkSession, sf_dir: str, league_id: str | None = None) -> DataFrame:
    recs = roster_records(spark, sf_dir)
    return sv.rosters(recs, column_fields(recs), league_id=league_id)


def silver_leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = league_records(spark, sf_dir)
    return sv.leagues(recs, column_fields(recs))


def ingested_league_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """League ids present in bronze rosters (no dedup needed for presence)."""
    recs = roster_records(spark, sf_dir)
    return sv.conform_rosters(recs, column_fields(recs)).select("league_id")
