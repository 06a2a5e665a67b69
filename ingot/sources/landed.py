"""Landed source payloads -> bronze rows.

The upstream API is not called from Spark. Its JSON responses are landed as
files, and one distributed scan turns any number of them into bronze rows:

    {landing}/players/*.json                  map {player_id: player} (or a list), one document per file
    {landing}/players/*.jsonl                 the same, one document per line
    {landing}/league/{league_id}.json         one league object (``null`` / absent = no league)
    {landing}/rosters/{league_id}.json        list of roster objects
    {landing}/matchups/{league_id}/{week}.json list of matchup objects
    {landing}/{league,rosters,matchups}/*.jsonl  the same for many leagues: a line {league_id, week, payload: text} each

League id and week come from the file path, so ingesting many leagues is one
job, not a loop. A player snapshot that is one ``.json`` document is read in byte ranges by many tasks
(:mod:`ingot.sources.ranges`); the payload of a league is parsed by one.

Nothing is lost: a payload that is not JSON is one row with its whole text and
``is_malformed``; so is each element (and each league payload) that is JSON but no
object, because no key can be injected into it. So is a line that cannot be read as {league_id, week, payload}: as
its league or week is unknown, every ingest that would take one of its file takes it, with the whole line as text.

Key injection follows ``{"league_id": L, **payload}``: the payload wins when
it carries the key itself, even with a null value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingot.functions.expr import inject_keys
from ingot.session import configure
from ingot.sources import bronze, files
from ingot.sources.ranges import entries, parsed_entries

SOURCE_ID = "league_api"
PAYLOAD_MAP = "map<string,variant>"
PAYLOAD_LIST = "array<variant>"
LANDED_TEXT = {"compression": "gzip"}  # of the JSON Lines that a job lands itself: as plain text they are more than all else it writes
LINE = "league_id string, week string, payload string, cut string"

Leagues = list[str] | DataFrame


def _read_payloads(spark: SparkSession, pattern: str, whole: bool = True) -> DataFrame | None:
    """Documents as rows ``(value, doc VARIANT, _file, _block)``; None when no file matches."""
    if not files.matches(spark, pattern):
        return None
    df = spark.read.text(pattern, wholetext=whole)
    if not whole:
        df = df.where(~F.col("value").rlike(r"^\s*$"))
    return df.select(
        "value", F.try_parse_json("value").alias("doc"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def _rows(df: DataFrame, record: Column, pos: Column, bad: Column, tbl: str, batch_id: int) -> DataFrame:
    return df.select(
        F.lit(batch_id).cast("long").alias("_batch_id"),
        F.lit("").alias("_writer"),
        "_file",
        F.col("_block").cast("long").alias("_block"),
        pos.cast("long").alias("_pos"),
        record.alias("record"),
        bad.alias("is_malformed"),
        F.lit(SOURCE_ID).alias("source_id"),
        F.lit(tbl).alias("tbl"),
    )


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], bronze.BRONZE_SCHEMA)


def _item(key: Column, value: Column, text: Column) -> Column:
    """An entry of a payload, or (with text) a payload that could not be parsed."""
    return F.struct(key.cast("string").alias("k"), value.alias("v"), text.cast("string").alias("bad"))


def _items(as_map: Column | None = None) -> Column:
    """The payload's entries; one marked entry if it isn't JSON, none if it is neither a map nor a list."""
    none = F.lit(None)
    as_list = F.transform(F.try_variant_get("doc", "$", PAYLOAD_LIST), lambda v: _item(none, v, none))
    out = F.when(F.col("doc").isNull(), F.array(_item(none, none.cast("variant"), F.col("value"))))
    if as_map is not None:
        out = out.when(as_map.isNotNull(), F.transform(F.map_entries(as_map), lambda e: _item(e["key"], e["value"], none)))
    return out.otherwise(as_list)


# --------------------------------------------------------------------------- S5 broad snapshot
def players_snapshot(
    spark: SparkSession, landing: str, batch_id: int = 0, pattern: str = "players/*.json", whole: bool = True
) -> DataFrame:
    """Map payload -> one record per entry with the key injected as ``player_id``;
    a non-object value becomes ``{player_id, raw}``; a list payload is used as is;
    any other payload yields no rows. ``whole=False``: one payload per line."""
    configure(spark)
    t = _read_payloads(spark, f"{landing.rstrip('/')}/{pattern}", whole)
    if t is None:
        return _empty(spark)
    items = _items(F.try_variant_get("doc", "$", PAYLOAD_MAP))
    if whole:
        ex = t.select("_file", "_block", F.posexplode(items).alias("_p", "item")).repartition("_file", "_p")
    else:
        # lines keep the order of the scan; positions are taken above it and written with the rows
        ex = t.select("_file", "_block", F.explode(items).alias("item")).withColumn("_p", F.monotonically_increasing_id())
    return _player_rows(ex, batch_id)


def players_document(spark: SparkSession, landing: str, batch_id: int = 0, pattern: str = "players/*.json") -> DataFrame:
    """S5 on documents of any size: the rows of :func:`players_snapshot`, each document read in byte ranges by many tasks.

    Of a document that is not JSON the readable entries are rows, and each other text between them is a malformed one.
    """
    configure(spark)
    path = f"{landing.rstrip('/')}/{pattern}"
    if not files.matches(spark, path):
        return _empty(spark)
    found = parsed_entries(entries(spark, path)).withColumnRenamed("text", "value")
    items = _items(F.try_variant_get("doc", "$", PAYLOAD_MAP))
    return _player_rows(found.select("_file", "_block", "_p", F.explode(items).alias("item")), batch_id)


def _player_rows(ex: DataFrame, batch_id: int) -> DataFrame:
    k, v, bad = F.col("item.k"), F.col("item.v"), F.col("item.bad")
    obj = F.try_variant_get(v, "$", PAYLOAD_MAP)
    rec = (
        F.when(bad.isNotNull(), bad)
        .when(k.isNull(), F.to_json(v))
        .when(obj.isNotNull(), F.to_json(inject_keys(obj, player_id=k)))
        .otherwise(F.to_json(F.create_map(F.lit("player_id"), k.cast("variant"), F.lit("raw"), v)))
    )
    return _rows(ex, rec, F.col("_p"), bad.isNotNull(), "players", batch_id)


# --------------------------------------------------------------------------- S6 league scoped
def _of_leagues(
    spark: SparkSession, landing: str, pattern: str, path: str, league_ids: Leagues, lines: bool, week: int | None = None
) -> DataFrame | None:
    """The payloads of the requested leagues, with their id from the file path or the line."""
    folder = f"{landing.rstrip('/')}/{pattern.split('/')[0]}"
    t = _read_payloads(spark, f"{folder}/*.jsonl" if lines else f"{landing.rstrip('/')}/{pattern}", not lines)
    if t is None:
        return None
    if lines:
        line = F.from_json("value", LINE, {"columnNameOfCorruptRecord": "cut"})
        at = F.col("_l.week").try_cast("bigint")
        # no league can be told from a line that is not one JSON object, whatever the parser made of its beginning;
        # within brackets, because the parsers stop after a first value
        alone = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))), "$", PAYLOAD_LIST))
        unread = ~alone.eqNullSafe(F.lit(1)) | F.col("_l.cut").isNotNull() | F.col("_l.league_id").isNull()
        bad = unread | F.col("_l.payload").isNull() | (F.lit(False) if week is None else at.isNull())
        t = t.withColumn("_l", line).withColumns({"_bad": bad, "_league": F.when(~unread, F.col("_l.league_id"))})
        if week is not None:
            t = t.where(F.col("_bad") | (at == week))
        text = F.when(F.col("_bad"), F.col("value")).otherwise(F.col("_l.payload"))
        t = t.select(text.alias("value"), F.when(~F.col("_bad"), F.try_parse_json("_l.payload")).alias("doc"), "_file", "_block", "_league")
    else:
        t = t.withColumn("_league", F.regexp_extract("_file", path, 1))
    if isinstance(league_ids, DataFrame):
        ids = league_ids.select(F.col(league_ids.columns[0]).cast("string").alias("_league"))
        known = t.join(ids, "_league", "left_semi")
        return known.unionByName(t.where(F.col("_league").isNull())) if lines else known
    return t.where(F.col("_league").isNull() | F.col("_league").isin([str(i) for i in league_ids]))


def league_records(spark: SparkSession, landing: str, league_ids: Leagues, batch_id: int = 0, lines: bool = False) -> DataFrame:
    """One record per league payload, ``league_id`` injected; null/absent -> no row."""
    configure(spark)
    t = _of_leagues(spark, landing, "league/*.json", r"/league/([^/]+)\.json$", league_ids, lines)
    if t is None:
        return _empty(spark)
    obj = F.try_variant_get("doc", "$", PAYLOAD_MAP)
    t = t.where(F.col("doc").isNull() | ~F.is_variant_null("doc")).withColumn("_obj", obj)
    rec = F.when(F.col("_obj").isNull(), F.col("value")).otherwise(F.to_json(inject_keys(F.col("_obj"), league_id=F.col("_league"))))
    return _rows(t, rec, F.monotonically_increasing_id() if lines else F.lit(0), F.col("_obj").isNull(), "league", batch_id)


def _list_records(t: DataFrame, tbl: str, inject: dict[str, Column], batch_id: int, lines: bool) -> DataFrame:
    ex = t.select(
        "_file", "_block", *[c.alias(f"_inj_{k}") for k, c in inject.items()], F.posexplode(_items()).alias("_p", "item")
    )
    v, bad = F.col("item.v"), F.col("item.bad")
    ex = ex.withColumn("_obj", F.try_variant_get(v, "$", PAYLOAD_MAP))
    if lines:  # a file holds many payloads: positions in the order of the scan
        ex = ex.withColumn("_p", F.monotonically_increasing_id())
    rec = (
        F.when(bad.isNotNull(), bad)
        .when(F.col("_obj").isNull(), F.to_json(v))
        .otherwise(F.to_json(inject_keys(F.col("_obj"), **{k: F.col(f"_inj_{k}") for k in inject})))
    )
    return _rows(ex, rec, F.col("_p"), F.col("_obj").isNull(), tbl, batch_id)


def roster_records(spark: SparkSession, landing: str, league_ids: Leagues, batch_id: int = 0, lines: bool = False) -> DataFrame:
    """One record per roster, ``league_id`` injected; a non-list payload -> no rows."""
    configure(spark)
    t = _of_leagues(spark, landing, "rosters/*.json", r"/rosters/([^/]+)\.json$", league_ids, lines)
    if t is None:
        return _empty(spark)
    return _list_records(t, "rosters", {"league_id": F.col("_league")}, batch_id, lines)


def matchup_records(
    spark: SparkSession, landing: str, league_ids: Leagues, week: int = 1, batch_id: int = 0, lines: bool = False
) -> DataFrame:
    """One record per matchup, ``league_id`` and ``week`` injected."""
    configure(spark)
    path = r"/matchups/([^/]+)/[^/]+\.json$"
    t = _of_leagues(spark, landing, f"matchups/*/{int(week)}.json", path, league_ids, lines, int(week))
    if t is None:
        return _empty(spark)
    return _list_records(t, "matchups", {"league_id": F.col("_league"), "week": F.lit(int(week)).cast("bigint")}, batch_id, lines)


def league_scoped(spark: SparkSession, landing: str, league_ids: Leagues, week: int = 1, batch_id: int = 0) -> DataFrame:
    """League, rosters and matchups of many leagues as one DataFrame (one write).
    Rosters and matchups are ingested even when the league payload is missing."""
    out = _empty(spark)
    for lines in (False, True):
        out = (
            out.unionByName(league_records(spark, landing, league_ids, batch_id, lines))
            .unionByName(roster_records(spark, landing, league_ids, batch_id, lines))
            .unionByName(matchup_records(spark, landing, league_ids, week, batch_id, lines))
        )
    return out


# --------------------------------------------------------------------------- S7 dispatch
def ingest(spark: SparkSession, landing: str, root: str, league_id: str | Leagues | None = None, week: int = 1) -> None:
    """A league id (or a list, or a DataFrame of ids) -> league-scoped ingest, else the broad snapshot."""
    if isinstance(league_id, DataFrame) or league_id:
        ids = [league_id] if isinstance(league_id, str) else league_id
        rows = league_scoped(spark, landing, ids, week)
        tables = [(SOURCE_ID, "league"), (SOURCE_ID, "rosters"), (SOURCE_ID, "matchups")]
        bronze.append(rows, root, tables, index={"league": "league_id", "rosters": "league_id"}, variant=True)
    else:
        rows = players_document(spark, landing)
        rows = rows.unionByName(players_snapshot(spark, landing, pattern="players/*.jsonl", whole=False))
        bronze.append(rows, root, [(SOURCE_ID, "players")], variant=True)
