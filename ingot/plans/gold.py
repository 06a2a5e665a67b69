"""Gold datasets: the business answers.

All functions are lazy DataFrame builders over silver DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingot.functions.expr import score
from ingot.operators.dedup import FIRST_SEQ
from ingot.operators.joins import anti_join, lookup_join, missing_keys
from ingot.operators.limit import WAIVER_LIMIT, first_n
from ingot.plans import silver as sv

# The session setting that names the league of requests without one.
DEFAULT_LEAGUE_CONF = "spark.ingot.default.league"


class _AllPlayers:
    """The request for every player, whatever the default league."""

    def __repr__(self) -> str:
        return "ALL_PLAYERS"


ALL_PLAYERS = _AllPlayers()


def league_or_default(spark: SparkSession, league_id: str | _AllPlayers | None) -> str | None:
    """The given league, else the configured default; None for all players."""
    if league_id is ALL_PLAYERS:
        return None
    return league_id or spark.conf.get(DEFAULT_LEAGUE_CONF, None) or None


def _requested(spark: SparkSession, league_ids: Iterable[str] | DataFrame) -> DataFrame:
    """Requested league ids as a one-column DataFrame (a driver-side list has a known size)."""
    if isinstance(league_ids, DataFrame):
        return league_ids.select(F.col(league_ids.columns[0]).cast("string").alias("league_id"))
    return spark.createDataFrame([(str(x),) for x in league_ids], "league_id string")


# --------------------------------------------------------------------------- G1 / J1 / P4
def available_players(
    silver_players: DataFrame,
    silver_rosters: DataFrame,
    league_id: str | _AllPlayers | None = None,
) -> DataFrame:
    """J1 + P14 + P15: players on no roster of ``league_id``.

    None or '' means the configured default league, or all players when there is
    none; ``ALL_PLAYERS`` asks for them in any case. ``silver_rosters`` may be unfiltered: the
    league filter reaches the roster scan through the latest-wins aggregate.
    """
    league_id = league_or_default(silver_players.sparkSession, league_id)
    if not league_id:
        return silver_players
    rostered = silver_rosters.where(F.col("league_id") == F.lit(str(league_id))).select(
        F.explode("players").alias("player_id")
    )
    return anti_join(silver_players, rostered, "player_id")


def player_objects(players: DataFrame) -> DataFrame:
    """The API player object; ``id`` duplicates ``player_id``. Columns that the players were built without are left out."""
    wanted = [c for c in ("player_id", "name", "position", "team", "status", "age", "trending") if c in players.columns]
    return players.select(F.col("player_id").alias("id"), *wanted, FIRST_SEQ)


def gold_available_players(silver_players, silver_rosters, league_id=None) -> DataFrame:
    """G1: available players shaped as API objects."""
    return player_objects(available_players(silver_players, silver_rosters, league_id))


# --------------------------------------------------------------------------- G2 / P5
def injury_report(silver_players: DataFrame, league_id: str | None = None) -> DataFrame:
    """player_id, status, updated_at. ``league_id`` is accepted and, as in the
    reference, does not filter. JSON export via :func:`to_json_lines` omits a NULL updated_at."""
    del league_id
    found = sv.injuries(silver_players)
    return found.select(*[F.col(c).cast("string").alias(c) if c == "updated_at" else c for c in found.columns])


# --------------------------------------------------------------------------- G3 / J3 / P7
def validate_leagues(
    spark: SparkSession, silver_leagues: DataFrame, league_ids: Iterable[str] | DataFrame
) -> DataFrame:
    """One row per requested id: (league_id, valid, league_name)."""
    requested = _requested(spark, league_ids)
    joined = lookup_join(requested, silver_leagues.select("league_id", "name"), "league_id", not isinstance(league_ids, DataFrame))
    return joined.select(
        "league_id",
        F.col("name").isNotNull().alias("valid"),
        F.coalesce(F.col("name"), F.lit("")).alias("league_name"),
    )


# --------------------------------------------------------------------------- J4
def leagues_missing(
    spark: SparkSession, ingested_league_ids: DataFrame, league_ids: Iterable[str] | DataFrame
) -> DataFrame:
    """Requested leagues with no data in bronze yet (the ones a lazy ingest must fetch)."""
    return missing_keys(
        _requested(spark, league_ids), ingested_league_ids.select("league_id"), "league_id", not isinstance(league_ids, DataFrame)
    )


# --------------------------------------------------------------------------- G4 / L1 / P6
def waiver_recommendations(
    silver_players: DataFrame,
    silver_rosters: DataFrame,
    league_id: str | None = None,
    limit: int = WAIVER_LIMIT,
    order: str = "arrival",
) -> DataFrame:
    """The first ``limit`` available players with a score.

    ``order="arrival"`` (the reference's behaviour) takes players in first-seen
    order and does not sort by score; ``order="score"`` takes the best scores
    (ties in first-seen order). Either way the plan is a TakeOrderedAndProject.
    """
    avail = available_players(silver_players, silver_rosters, league_id)
    with_score = avail.select("player_id", "name", "position", "team", score(F.col("trending")).alias("score"), FIRST_SEQ)
    if order == "arrival":
        keys = [F.col(FIRST_SEQ)]
    elif order == "score":
        keys = [F.col("score").desc(), F.col(FIRST_SEQ)]
    else:
        raise ValueError(f"unknown order: {order!r}")
    return first_n(with_score, keys, limit)


# --------------------------------------------------------------------------- export
def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row (NULL fields omitted), internal columns dropped."""
    pub = sv.public(df)
    return pub.select(F.to_json(F.struct(*pub.columns)).alias("value"))
