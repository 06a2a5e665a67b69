"""Silver datasets: conformed, validated, deduplicated.

Every function takes a *record DataFrame* - one row per raw record - plus a
field accessor (see :mod:`ingot.functions.expr`) and the name of its
sequence column. Parsed bronze gives ``json_fields("record_v")`` and
``_seq``; typed sources give ``column_fields(df.columns)``.

Invalid records are dropped *before* deduplication, so a late invalid record
never hides an earlier valid one. The outputs carry two internal columns,
``_seq`` (the winner's sequence) and ``_first_seq`` (the key's first valid
arrival), which order samples and recommendations; :func:`public` drops them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ingot.functions.expr import FieldAccessor, json_fields, player_id_text, s_or, stage_fields, text_or
from ingot.operators.dedup import FIRST_SEQ, SEQ, latest_wins
from ingot.schema import SILVER_INJURY_KEYS, SILVER_LEAGUE_KEYS, SILVER_MATCHUP_KEYS, SILVER_PLAYER_KEYS, SILVER_ROSTER_KEYS


def public(df: DataFrame) -> DataFrame:
    """Drop internal (underscore) columns."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


# --------------------------------------------------------------------------- players
# What a silver column is made of: the record's fields, and how.
_PLAYER_COLUMNS = {
    "player_id": (("player_id", "id"), lambda f: player_id_text()),
    "name": (("display_name", "name"), lambda f: text_or("display_name", "name")),
    "position": (("position",), lambda f: text_or("position")),
    "team": (("team",), lambda f: text_or("team")),
    "status": (("status",), lambda f: text_or("status")),
    "injury_status": (("injury_status",), lambda f: text_or("injury_status")),
    "age": (("age",), lambda f: f["age"].as_int()),
    "trending": (("trending",), lambda f: f["trending"].as_float()),
    "updated_at": (("updated_at", "injury_updated"), lambda f: text_or("updated_at", "injury_updated", default=None)),
}
_PLAYER_NUMBERS = {"trending": "double"}  # read as that
INJURY_COLUMNS = ("player_id", "status", "injury_status")  # that say who is a player, and who is injured


def conform_players(
    records: DataFrame, fields: FieldAccessor | None = None, seq: str = SEQ, columns: Sequence[str] = SILVER_PLAYER_KEYS
) -> DataFrame:
    """P1 + P8: raw player record -> silver columns; records without an id are dropped.

    ``columns``: those that are wanted, ``player_id`` among them; no field that only others need is read.
    """
    inputs = [n for c in columns for n in _PLAYER_COLUMNS[c][0]]
    staged, f = stage_fields(records, fields or json_fields(), inputs, [F.col(seq).alias(SEQ)], _PLAYER_NUMBERS)
    conformed = staged.select(*[_PLAYER_COLUMNS[c][1](f).alias(c) for c in columns], SEQ)
    return conformed.where(F.col("player_id").isNotNull())


def players(
    records: DataFrame, fields: FieldAccessor | None = None, seq: str = SEQ, method: str = "max_by", columns: Sequence[str] = SILVER_PLAYER_KEYS
) -> DataFrame:
    """A1: silver players, latest record per player_id wins.

    The winner is one struct, out of which the optimizer drops no column that nobody reads: say by ``columns`` which are wanted.
    """
    return latest_wins(conform_players(records, fields, seq, columns), ["player_id"], method=method).select(*columns, SEQ, FIRST_SEQ)


# --------------------------------------------------------------------------- leagues
def conform_leagues(records: DataFrame, fields: FieldAccessor | None = None, seq: str = SEQ) -> DataFrame:
    """P2 + P9: raw league record -> (league_id, name); falsy ids are dropped."""
    staged, _ = stage_fields(records, fields or json_fields(), ("league_id", "name", "league_name"), [F.col(seq).alias(SEQ)])
    return staged.where(~F.col("_f_league_id")).select(
        F.col("_t_league_id").alias("league_id"),
        text_or("name", "league_name").alias("name"),
        SEQ,
    )


def leagues(records: DataFrame, fields: FieldAccessor | None = None, seq: str = SEQ) -> DataFrame:
    """A2: silver leagues, latest record per league_id wins."""
    return latest_wins(conform_leagues(records, fields, seq), ["league_id"]).select(*SILVER_LEAGUE_KEYS, SEQ, FIRST_SEQ)


def league_lookup(silver_leagues: DataFrame, league_id: str) -> DataFrame:
    """The league with this id (zero or one row)."""
    return silver_leagues.where(F.col("league_id") == F.lit(str(league_id))).limit(1)


# --------------------------------------------------------------------------- rosters
def conform_rosters(records: DataFrame, fields: FieldAccessor | None = None, seq: str = SEQ) -> DataFrame:
    """P3 + P10: raw roster record -> (league_id, roster_id, players); NULL ids are dropped.

    Unlike leagues, a roster keeps falsy-but-present ids such as ``0`` or ``""``.
    """
    f = fields or json_fields()
    lid, rid, pl = f("league_id"), f("roster_id"), f("players")
    conformed = records.select(
        lid.text().alias("league_id"),
        rid.text().alias("roster_id"),
        pl.as_str_array().alias("players"),
        F.col(seq).alias(SEQ),
    )
    return conformed.where(F.col("league_id").isNotNull() & F.col("roster_id").isNotNull())


def rosters(
    records: DataFrame,
    fields: FieldAccessor | None = None,
    seq: str = SEQ,
    league_id: str | None = None,
) -> DataFrame:
    """A3 (+ P11): silver rosters, latest record per (league_id, roster_id) wins.

    The optional league filter is applied before deduplication; it references a
    grouping key, so it is equivalent after it and Catalyst pushes it to the scan.
    """
    conformed = conform_rosters(records, fields, seq)
    if league_id is not None:
        conformed = conformed.where(F.col("league_id") == F.lit(str(league_id)))
    return latest_wins(conformed, ["league_id", "roster_id"]).select(*SILVER_ROSTER_KEYS, SEQ, FIRST_SEQ)


# --------------------------------------------------------------------------- matchups
def conform_matchups(records: DataFrame, fields: FieldAccessor | None = None, seq: str = SEQ) -> DataFrame:
    """Raw matchup record -> silver columns; records without league, week or roster are dropped, a bye has no matchup_id."""
    f = fields or json_fields()
    conformed = records.select(
        f("league_id").text().alias("league_id"), f("week").as_int().alias("week"), f("matchup_id").text().alias("matchup_id"),
        f("roster_id").text().alias("roster_id"), f("points").as_float().alias("points"), F.col(seq).alias(SEQ),
    )
    return conformed.where(F.col("league_id").isNotNull() & F.col("week").isNotNull() & F.col("roster_id").isNotNull())


def matchups(records: DataFrame, fields: FieldAccessor | None = None, seq: str = SEQ) -> DataFrame:
    """Silver matchups, latest record per (league_id, week, roster_id) wins: a roster plays one matchup a week."""
    return latest_wins(conform_matchups(records, fields, seq), ["league_id", "week", "roster_id"]).select(*SILVER_MATCHUP_KEYS, SEQ, FIRST_SEQ)


def rostered_player_ids(silver_rosters: DataFrame, league_id: str | None = None) -> DataFrame:
    """A4: distinct (league_id, player_id) over the rosters, optionally of one league."""
    r = silver_rosters
    if league_id is not None:
        r = r.where(F.col("league_id") == F.lit(str(league_id)))
    return r.select("league_id", F.explode("players").alias("player_id")).distinct()


def roster_players(silver_rosters: DataFrame, league_id: str | None = None) -> DataFrame:
    """(roster_id, player_id) rows of a league's rosters, duplicates kept."""
    r = silver_rosters
    if league_id is not None:
        r = r.where(F.col("league_id") == F.lit(str(league_id)))
    return r.select("league_id", "roster_id", F.explode("players").alias("player_id"))


# --------------------------------------------------------------------------- injuries
def is_injured() -> Column:
    """P12's condition on silver players: ``injury_status or status`` is set and not 'Active' (case-sensitive)."""
    return ~s_or("injury_status", "status").isin("", "Active")


def injuries(silver_players: DataFrame) -> DataFrame:
    """The injured players; of players built without ``updated_at`` that column is left out."""
    status = s_or("injury_status", "status")
    wanted = [status.alias(c) if c == "status" else c for c in SILVER_INJURY_KEYS if c in silver_players.columns]
    return silver_players.where(is_injured()).select(*wanted, FIRST_SEQ)
