"""Catalog, samples and run log.

The catalog is one lazy DataFrame. Four of its entries are counts over silver
players, taken in one aggregate; leagues and rosters are one more each.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingot.operators.dedup import FIRST_SEQ
from ingot.operators.limit import RUN_HISTORY, SAMPLE_ROWS, first_n, newest_n
from ingot.operators.ranking import ranked
from ingot.plans import gold
from ingot.plans import silver as sv
from ingot.schema import RUNS
from ingot.sources import bronze

SILVER_NAMES = ("players", "league", "rosters", "injuries")
GOLD_NAMES = ("available_players", "injury")


def _count(df: DataFrame, layer: str, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(layer).alias("layer"), F.lit(name).alias("name"), F.col("row_count").cast("long").alias("row_count")
    )


def silver_gold_datasets(players: DataFrame, leagues: DataFrame, rosters: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """The named silver and gold datasets the catalog and samples expose."""
    return {
        ("silver", "players"): players,
        ("silver", "league"): leagues,
        ("silver", "rosters"): rosters,
        ("silver", "injuries"): sv.injuries(players),
        # as in the reference, the catalog counts available players without a league
        ("gold", "available_players"): gold.gold_available_players(players, rosters, gold.ALL_PLAYERS),
        ("gold", "injury"): gold.injury_report(players),
    }


def catalog_silver_gold(players: DataFrame, leagues: DataFrame, rosters: DataFrame) -> DataFrame:
    """(layer, name, row_count) of the four silver and two gold datasets."""
    one = players.agg(F.count(F.lit(1)).alias("all"), F.count_if(sv.is_injured()).alias("injured"))
    entry = lambda layer, name, n: F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("name"), F.col(n).alias("row_count"))
    entries = F.array(
        entry("silver", "players", "all"), entry("silver", "injuries", "injured"),
        # as in the reference, available players are counted without a league
        entry("gold", "available_players", "all"), entry("gold", "injury", "injured"),
    )
    rest = _count(leagues, "silver", "league").unionByName(_count(rosters, "silver", "rosters"))
    return one.select(F.inline(entries)).unionByName(rest)


def catalog_all(bronze_rows: DataFrame, players: DataFrame, leagues: DataFrame, rosters: DataFrame, listing=None) -> DataFrame:
    """Every layer in one table (layer, source_id, name, row_count)."""
    b = bronze.catalog(bronze_rows, listing)
    sg = catalog_silver_gold(players, leagues, rosters).select(
        "layer", F.lit(None).cast("string").alias("source_id"), "name", "row_count"
    )
    return b.unionByName(sg)


def catalog_store(spark: SparkSession, root: str, players: DataFrame, leagues: DataFrame, rosters: DataFrame) -> DataFrame:
    """G5 of a store: its bronze counts come from the commit log, so no bronze row is read for them."""
    sg = catalog_silver_gold(players, leagues, rosters).select("layer", F.lit(None).cast("string").alias("source_id"), "name", "row_count")
    return bronze.catalog_at(spark, root).unionByName(sg)


def catalog_incremental(spark: SparkSession, root: str, counts: dict[str, int]) -> DataFrame:
    """G5 from what the commit log and the silver tables' manifests carry (``counts``, by silver name): no row of any layer is read."""
    rows = [("silver", n, counts[n]) for n in SILVER_NAMES]
    # as in the reference, available players are counted without a league
    rows += [("gold", "available_players", counts["players"]), ("gold", "injury", counts["injuries"])]
    sg = spark.createDataFrame(rows, "layer string, name string, row_count long")
    return bronze.catalog_at(spark, root).unionByName(sg.select("layer", F.lit(None).cast("string").alias("source_id"), "name", "row_count"))


# --------------------------------------------------------------------------- samples
def sample(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """L2 for silver/gold: the first ``n`` rows in first-seen order."""
    if FIRST_SEQ not in df.columns:
        raise ValueError(f"a sample needs the order column {FIRST_SEQ}")
    return first_n(df, [FIRST_SEQ], n)


def sample_table(
    datasets: dict[tuple[str, str], DataFrame],
    layer: str,
    name: str,
    table: str | None = None,
    bronze_rows: DataFrame | None = None,
    n: int = SAMPLE_ROWS,
) -> DataFrame:
    """Sample any dataset. Bronze is addressed as (source_id, table) and an
    unknown bronze table yields zero rows; unknown layers and silver/gold names raise."""
    if layer == "bronze":
        if table is None:
            raise ValueError("bronze sample needs a source id and a table")
        if bronze_rows is None:
            raise ValueError("bronze sample needs the bronze rows")
        rows = bronze_rows.where((F.col("source_id") == F.lit(name)) & (F.col("tbl") == F.lit(table)))
        return bronze.first_rows(rows, n)
    if layer not in ("silver", "gold"):
        raise ValueError(f"unknown layer: {layer}")
    if (layer, name) not in datasets:
        raise KeyError(f"unknown {layer} table: {name}")
    return sample(datasets[(layer, name)], n)


# --------------------------------------------------------------------------- run log
def record_run(spark: SparkSession, root: str, kind: str, league_id: str | None = None, ts: _dt.datetime | None = None) -> None:
    """Append one run to ``{root}/runs``."""
    record_runs(spark, root, kind, [league_id], ts)


def record_runs(
    spark: SparkSession, root: str, kind: str, league_ids: list[str | None] | DataFrame, ts: _dt.datetime | None = None
) -> None:
    """Append runs in order: the time (F13) is taken on the driver once, ``seq`` keeps the order within the call.

    A DataFrame (league_id, then the columns of its order) of any size is numbered and written by Spark.
    """
    when = ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    if isinstance(league_ids, DataFrame):
        first, *order = league_ids.columns
        rows = ranked(league_ids, order or [first], name="_seq").select(
            F.lit(kind).alias("kind"), F.col(first).cast("string").alias("league_id"), F.lit(when).alias("ts"), F.col("_seq").alias("seq")
        )
    else:
        rows = spark.createDataFrame([(kind, lid, when, i) for i, lid in enumerate(league_ids)], RUNS)
    rows.write.mode("append").parquet(f"{root.rstrip('/')}/runs")


def latest_runs(spark: SparkSession, root: str, n: int = RUN_HISTORY) -> DataFrame:
    """L3: the newest ``n`` runs; of equal times the later one in its call."""
    return newest_n(spark.read.schema(RUNS).parquet(f"{root.rstrip('/')}/runs"), "ts", n, ["seq", "league_id", "kind"])
