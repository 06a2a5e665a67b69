"""Answers for all leagues at once (X3, X4), without leagues x players rows.

The players get a global rank. What a league excludes is a set of ranks, and both answers come from that set:

* ``waiver_all``: the first N ranks it leaves free, found by gap enumeration (``ranking.first_free``), then
  looked up among the players by an equi-join on the rank.
* ``available_all``: the set itself, as bitmaps of 32,768 ranks each, and the number of players outside it;
  ``expand`` makes the rows of one league from its bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingot.functions.expr import score
from ingot.operators.dedup import FIRST_SEQ
from ingot.operators.limit import WAIVER_LIMIT
from ingot.operators.ranking import first_free, ranked
from ingot.plans import silver as sv
from ingot.session import stored

ORDERS = ("arrival", "score")


def ranked_players(silver_players: DataFrame, order: str = "arrival") -> DataFrame:
    """The players with ``rank``, from 0: in first-seen order, or by score and then first seen."""
    if order not in ORDERS:
        raise ValueError(f"unknown order: {order!r}")
    players = silver_players.withColumn("score", score(F.col("trending")))
    return stored(ranked(players, [FIRST_SEQ] if order == "arrival" else [F.col("score").desc(), FIRST_SEQ]), "ranked")


def excluded_ranks(players: DataFrame, silver_rosters: DataFrame) -> DataFrame:
    """(league_id, rank) of the players on a league's rosters, each once; players: with their rank."""
    rostered = sv.rostered_player_ids(silver_rosters)
    return rostered.join(players.select("player_id", "rank"), "player_id").select("league_id", "rank")


def waiver_all(
    silver_players: DataFrame, silver_rosters: DataFrame, leagues: DataFrame, limit: int = WAIVER_LIMIT, order: str = "arrival"
) -> DataFrame:
    """(league_id, place from 0, player_id, name, position, team, score): G4 for each of ``leagues`` (league_id, each once)."""
    if limit < 0:
        raise ValueError(f"limit must be >= 0, got {limit}")
    players = ranked_players(silver_players, order)
    taken = excluded_ranks(players, silver_rosters).join(leagues.select("league_id"), "league_id", "left_semi")
    # most leagues ask for the same few ranks: those players alone are the lookup's other side, which is then small
    free = stored(first_free(taken, leagues, "league_id", limit), "free")
    asked = players.join(free.select("rank").distinct(), "rank", "left_semi")
    return free.join(asked, "rank").select("league_id", "place", "player_id", "name", "position", "team", "score")


# --------------------------------------------------------------------------- X3
def _bucket(rank: Column) -> Column:
    return F.bitmap_bucket_number(rank + 1)


def excluded_bitmaps(players: DataFrame, silver_rosters: DataFrame) -> DataFrame:
    """(league_id, bucket, bits): each league's excluded ranks; 4 KB for each bucket with any. Partial aggregates hold bitmaps, not rows."""
    rows = excluded_ranks(players, silver_rosters)
    rows = rows.select("league_id", _bucket(F.col("rank")).alias("bucket"), F.bitmap_bit_position(F.col("rank") + 1).alias("at"))
    return rows.groupBy("league_id", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def available_all(players: DataFrame, bitmaps: DataFrame, leagues: DataFrame) -> DataFrame:
    """(league_id, n_available, n_excluded, digest) of each of ``leagues``; the digest is that of its bitmaps in order."""
    line = F.concat(F.col("bucket").cast("string"), F.lit(":"), F.sha2("bits", 256))
    per = bitmaps.groupBy("league_id").agg(
        F.sum(F.bitmap_count("bits")).alias("n_excluded"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", line.alias("line")))), lambda x: x["line"]), ",").alias("lines"),
    )
    total = F.lit(players.count()).cast("long")
    out = leagues.select("league_id").join(per, "league_id", "left")
    excluded = F.coalesce("n_excluded", F.lit(0))
    return out.select(
        "league_id", (total - excluded).alias("n_available"), excluded.alias("n_excluded"),
        F.sha2(F.coalesce("lines", F.lit("")).cast("binary"), 256).alias("digest"),
    )


def expand(players: DataFrame, bitmaps: DataFrame, league_id: str) -> DataFrame:
    """G1 of one league from its bitmaps: the players (with rank) whose bit is not set."""
    mine = bitmaps.where(F.col("league_id") == F.lit(str(league_id))).select("bucket", "bits")
    at = F.bitmap_bit_position(F.col("rank") + 1)
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    rows = players.withColumn("bucket", _bucket(F.col("rank"))).join(mine, "bucket", "left")
    return rows.where(F.col("bits").isNull() | ~is_set).drop("bucket", "bits")
