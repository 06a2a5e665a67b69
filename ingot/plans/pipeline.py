"""The medallion pipeline: ingest -> bronze -> silver -> gold.

``run`` executes the layers in order against a bronze root. League ingest
is lazy: only requested leagues with no bronze data yet are fetched (J4),
unless ``refresh=True``; all of them in one distributed job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingot.functions.expr import clean_id_array, json_fields, parse_id_list
from ingot.plans import catalog as cat
from ingot.plans import gold
from ingot.plans import silver as sv
from ingot.session import configure, shuffles_dropped
from ingot.sources import bronze, files, landed

SOURCE_ID = landed.SOURCE_ID


def requested_ids(spark: SparkSession, league_ids: str | list | tuple | DataFrame) -> DataFrame:
    """F9 as rows ``league_id``: of a text (commas and line ends part it), a list, or a DataFrame."""
    if isinstance(league_ids, DataFrame):
        return league_ids.select(F.col(league_ids.columns[0]).cast("string").alias("league_id"))
    if isinstance(league_ids, str):
        ids = parse_id_list(F.lit(league_ids))
    else:
        ids = clean_id_array(F.array(*[F.lit(str(x)) for x in league_ids]))
    return spark.range(1).select(F.explode(ids).alias("league_id"))


def listed_ids(spark: SparkSession, league_ids: str | list | tuple) -> list[str]:
    """The same of a request that came as a text or a list."""
    return [r.league_id for r in requested_ids(spark, league_ids).collect()]


def ingested_league_ids(spark: SparkSession, root: str) -> DataFrame:
    """League ids with league or roster data in bronze, from the store's key files."""
    held = [bronze.keys(spark, root, SOURCE_ID, tbl) for tbl in ("league", "rosters")]
    return held[0].unionByName(held[1]).select(F.col("key").alias("league_id"))


def ingest_leagues(
    spark: SparkSession, landing: str, root: str, league_ids, refresh: bool = False, week: int = 1
) -> list[str]:
    """Ingest league, rosters and matchups for the requested leagues that
    are not in bronze yet (all of them with ``refresh``). Returns the fetched ids, of a request that came as a text or list."""
    configure(spark)
    ids = listed_ids(spark, league_ids)
    if not ids:
        raise ValueError("at least one league_id is required")
    missing = gold.leagues_missing(spark, ingested_league_ids(spark, root), ids)
    fetch = ids if refresh else [r["league_id"] for r in missing.collect()]  # no more than were asked for
    if fetch:
        landed.ingest(spark, landing, root, fetch, week)
    cat.record_runs(spark, root, "league", ids)
    return fetch


def ingest_broad(spark: SparkSession, landing: str, root: str) -> None:
    configure(spark)
    landed.ingest(spark, landing, root, None)
    cat.record_run(spark, root, "broad")


def silver_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Silver built lazily from bronze (players, league, rosters, matchups)."""
    f = json_fields()

    def get(tbl: str) -> DataFrame:
        return bronze.parsed_at(spark, root, SOURCE_ID, tbl).select("record_v", "_seq")

    return {
        "players": sv.players(get("players"), f),
        "league": sv.leagues(get("league"), f),
        "rosters": sv.rosters(get("rosters"), f),
        "matchups": sv.matchups(get("matchups"), f),
    }


def materialize_silver(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Write silver to Parquet and return DataFrames over the written copies.

    Gold queries then read conformed, typed columns (with pushdown) instead of
    re-parsing bronze JSON. Rosters are clustered by league and roster, so a one-league
    filter skips most row groups and a big league is not one task. Every call writes folders of its
    own and publishes them afterwards: what an earlier call returned stays readable.
    """
    out, version = {}, uuid.uuid4().hex
    for name, df in silver_tables(spark, root).items():
        path = f"{root.rstrip('/')}/silver/{name}"
        if name == "rosters":
            df = df.repartitionByRange("league_id", "roster_id").sortWithinPartitions("league_id", "roster_id")
        df.write.parquet(f"{path}/v={version}")
        files.publish(spark, f"{path}/_versions", f"{path}/v={version}")
        out[name] = spark.read.parquet(f"{path}/v={version}")
    return out


def current_silver(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest published version of a silver table."""
    path = f"{root.rstrip('/')}/silver/{name}"
    lines = files.current(spark, f"{path}/_versions")
    if not lines:
        raise FileNotFoundError(f"no silver {name} under {root}")
    return spark.read.parquet(lines[0])


def run(
    spark: SparkSession,
    landing: str,
    root: str,
    league_ids=None,
    broad: bool = True,
    league_id: str | None = None,
    refresh: bool = False,
) -> dict[str, DataFrame]:
    """Q5: bronze ingest -> silver -> gold, in that order."""
    configure(spark)
    with shuffles_dropped(spark):
        if broad:
            ingest_broad(spark, landing, root)
        if league_ids:
            ingest_leagues(spark, landing, root, league_ids, refresh)
        s = materialize_silver(spark, root)
    lid = league_id or (listed_ids(spark, league_ids)[0] if league_ids else None)
    return {
        "silver_players": s["players"],
        "silver_league": s["league"],
        "silver_rosters": s["rosters"],
        "silver_matchups": s["matchups"],
        "available_players": gold.gold_available_players(s["players"], s["rosters"], lid),
        "injury_report": gold.injury_report(s["players"], lid),
        "waiver": gold.waiver_recommendations(s["players"], s["rosters"], lid),
        "catalog": cat.catalog_all(
            bronze.scan(spark, root), s["players"], s["league"], s["rosters"],
            bronze.listing(spark, root),
        ),
        "runs": cat.latest_runs(spark, root),
    }


def validate(spark: SparkSession, root: str, league_ids) -> DataFrame:
    """G3 against the bronze root."""
    return gold.validate_leagues(spark, silver_tables(spark, root)["league"], listed_ids(spark, league_ids))


def available(spark: SparkSession, root: str, league_id: str | None) -> DataFrame:
    s = silver_tables(spark, root)
    return gold.gold_available_players(s["players"], s["rosters"], league_id)
