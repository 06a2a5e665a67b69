"""

The driver's tables play the reference's roles (see ``ingot.plans.roles``):
player = part, league = customer, roster = order, rostered players = the
parts on an order's line items. Every query reads the given tables whole.

Oracle notes
------------
* ``player_id or id``: a numeric ``0`` id is falsy and its record is dropped,
  so the oracles keep ``player_id <> 0`` (part 0 exists in the data).
* Oracles use ``QUALIFY row_number()`` for latest-wins (DuckDB's ``arg_max``
  skips NULL values, Spark's ``max_by`` does not).
"""

from __future__ import annotations

import datetime as dt
import sys
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ingot.functions.expr import column_fields, json_fields, parse_id_list  # noqa: E402
from ingot.operators.dedup import latest_wins  # noqa: E402
from ingot.operators.ranking import ranked  # noqa: E402
from ingot.operators.limit import RUN_HISTORY, SAMPLE_ROWS, first_n, newest_n  # noqa: E402
from ingot.plans import catalog as cat  # noqa: E402
from ingot.plans import gold, roles  # noqa: E402
from ingot.plans import leagues as multi  # noqa: E402
from ingot.plans import silver as sv  # noqa: E402
from ingot.plans import pipeline, sqlfiles  # noqa: E402
from ingot.schema import SILVER_PLAYER_KEYS  # noqa: E402
from ingot.session import at_least_partitions, configure, scratch_path, shuffles_dropped, stored  # noqa: E402
from ingot.sources import bronze, files  # noqa: E402
from ingot.sources import ingest as ing  # noqa: E402
from ingot.sources import landed  # noqa: E402
from ingot.sources.datasources import JsonLineFiles  # noqa: E402
from ingot.streaming import bronze_stream as bs  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"
LEAGUE = "7"  # the league the single-league queries ask about
REQUESTED = ["1", "7", "999999"]  # ids asked for by validation / lazy-ingest queries

_PLAYER_COLS = ("player_id", "name", "position", "team", "status", "injury_status", "age", "trending", "updated_at")
_OBJ_COLS = ("id", "player_id", "name", "position", "team", "status", "age", "trending")


def _p(spark: SparkSession, sf: str) -> DataFrame:
    return roles.silver_players(configure(spark), sf)


def _r(spark: SparkSession, sf: str) -> DataFrame:
    return roles.silver_rosters(configure(spark), sf)


# --------------------------------------------------------------------------- silver
def q_silver_players(spark, sf):
    return _p(spark, sf).select(*_PLAYER_COLS)


def q_silver_players_window(spark, sf):
    return roles.silver_players(configure(spark), sf, method="window").select(*_PLAYER_COLS)


def q_silver_rosters(spark, sf):
    return _r(spark, sf).select("league_id", "roster_id", F.explode("players").alias("player_id"))


def q_silver_leagues(spark, sf):
    return roles.silver_leagues(configure(spark), sf).select("league_id", "name")


def q_silver_matchups(spark, sf):
    """The latest score of each roster and week."""
    recs = roles.matchup_records(configure(spark), sf)
    return sv.matchups(recs, column_fields(recs)).select("league_id", "week", "matchup_id", "roster_id", "points")


def q_league_lookup(spark, sf):
    return sv.league_lookup(roles.silver_leagues(configure(spark), sf), LEAGUE).select("league_id", "name")


def q_silver_injuries(spark, sf):
    return sv.injuries(_p(spark, sf)).select("player_id", "status", "updated_at")


def q_rostered_player_ids(spark, sf):
    return sv.rostered_player_ids(_r(spark, sf))


def q_rosters_for_league(spark, sf):
    return sv.roster_players(_r(spark, sf), LEAGUE).select("roster_id", "player_id")


def q_lineitem_latest(spark, sf):
    """A3 on a two-column key of a base table: latest line per (order, line number)."""
    configure(spark)
    li = roles.table(spark, sf, "lineitem")
    recs = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate",
        F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("_seq"),
    )
    return latest_wins(recs, ["l_orderkey", "l_linenumber"], first_seq=None).drop("_seq")


def q_latest_event_per_user(spark, sf):
    """A1 on events: each user's latest event by (ts, event_id)."""
    configure(spark)
    ev = roles.table(spark, sf, "events")
    recs = ev.select("user_id", "event_type", "value", "ts", F.struct("ts", "event_id").alias("_seq"))
    return latest_wins(recs, ["user_id"], first_seq=None).drop("_seq")


def q_first_seen_players(spark, sf):
    return first_n(_p(spark, sf), ["_first_seq"], 20).select("player_id")


# --------------------------------------------------------------------------- gold
def q_available_players(spark, sf):
    return gold.available_players(_p(spark, sf), _r(spark, sf), LEAGUE).select(*_PLAYER_COLS)


def q_gold_available_players(spark, sf):
    return gold.gold_available_players(_p(spark, sf), _r(spark, sf), LEAGUE).select(*_OBJ_COLS)


def q_gold_injury_report(spark, sf):
    return gold.injury_report(_p(spark, sf), LEAGUE).select("player_id", "status", "updated_at")


def q_gold_league_validation(spark, sf):
    configure(spark)
    return gold.validate_leagues(spark, roles.silver_leagues(spark, sf), REQUESTED)


def q_leagues_missing(spark, sf):
    configure(spark)
    return gold.leagues_missing(spark, roles.ingested_league_ids(spark, sf), REQUESTED)


def q_gold_waiver(spark, sf):
    return gold.waiver_recommendations(_p(spark, sf), _r(spark, sf), LEAGUE, 20).select(
        "player_id", "name", "position", "team", "score"
    )


def q_gold_waiver_by_score(spark, sf):
    return gold.waiver_recommendations(_p(spark, sf), _r(spark, sf), LEAGUE, 20, order="score").select(
        "player_id", "name", "position", "team", "score"
    )


# --------------------------------------------------------------------------- all leagues
def _league_ids(spark, sf) -> DataFrame:
    return roles.silver_leagues(configure(spark), sf).select("league_id")


def q_waiver_all_leagues(spark, sf):
    """The first five available players of every league, in arrival order."""
    return multi.waiver_all(_p(spark, sf), _r(spark, sf), _league_ids(spark, sf), 5)


def q_waiver_all_leagues_by_score(spark, sf):
    """X4 by score."""
    return multi.waiver_all(_p(spark, sf), _r(spark, sf), _league_ids(spark, sf), 5, "score")


def q_available_all_leagues(spark, sf):
    """How many players each league has available, and a digest of the bitmaps that say which."""
    players = multi.ranked_players(_p(spark, sf))
    return multi.available_all(players, multi.excluded_bitmaps(players, _r(spark, sf)), _league_ids(spark, sf))


def q_available_expanded(spark, sf):
    """One league's available players, expanded from its bitmaps."""
    players = multi.ranked_players(_p(spark, sf))
    return multi.expand(players, multi.excluded_bitmaps(players, _r(spark, sf)), LEAGUE).select(*_PLAYER_COLS)


# --------------------------------------------------------------------------- the store of JSON records
_STORES: dict[tuple[str, str], str] = {}
_SRC = landed.SOURCE_ID


def _json_rows(recs: DataFrame, fields, order: list[str], tbl: str) -> DataFrame:
    """Bronze rows of records in the order of their sequence; without ``order`` they are in it."""
    if order:
        recs = recs.orderBy(*order)
    if "updated_at" in recs.columns:
        recs = recs.withColumn("updated_at", F.col("updated_at").cast("string"))
    lines = recs.select(
        F.to_json(F.struct(*fields)).alias("record"), F.lit("").alias("_file"), F.lit(0).cast("long").alias("_block")
    )
    return bronze.records_from_json_column(lines, "record", _SRC, tbl, variant=True)


def _snapshots(spark, sf) -> DataFrame:
    """Roster snapshots, made once: a sort reads its rows twice, the first time for the bounds of its ranges."""
    return stored(roles.roster_records(spark, sf), "snapshots")


def _store(spark, sf) -> str:
    """A bronze store with the JSON records of players, rosters and leagues, written once per session and input."""
    at_least_partitions(configure(spark), roles.partitions(spark, sf))
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        root, keys = scratch_path(spark, "store"), {"rosters": "league_id", "league": "league_id"}
        tables = [
            lambda: _json_rows(roles.player_records(spark, sf, ordered=True), roles.PLAYER_FIELDS, [], "players"),
            lambda: _json_rows(_snapshots(spark, sf), roles.ROSTER_FIELDS, ["_seq.s1", "roster_id"], "rosters"),
            lambda: _json_rows(roles.league_records(spark, sf), roles.LEAGUE_FIELDS, ["_seq.s1", "league_id"], "league"),
        ]
        with shuffles_dropped(spark), ThreadPoolExecutor(len(tables)) as pool:  # any number of writers may append at once
            list(pool.map(lambda rows: bronze.append(rows(), root, index=keys, variant=True), tables))
        bronze.register_table(spark, root, _SRC, "matchups")  # a table without rows yet
        _STORES[key] = root
    return _STORES[key]


def _records(spark, sf, tbl) -> DataFrame:
    return bronze.parsed_at(spark, _store(spark, sf), _SRC, tbl).select("record_v", "_seq")


def _silver_json(spark, sf, columns=SILVER_PLAYER_KEYS) -> dict[str, DataFrame]:
    """Silver from the store's records; players with these columns."""
    return {
        "players": sv.players(_records(spark, sf, "players"), columns=columns),
        "rosters": sv.rosters(_records(spark, sf, "rosters")),
        "league": sv.leagues(_records(spark, sf, "league")),
    }


def q_silver_players_json(spark, sf):
    """Silver players from JSON text in the bronze store."""
    return _silver_json(spark, sf)["players"].select(*_PLAYER_COLS)


def q_silver_rosters_json(spark, sf):
    return _silver_json(spark, sf)["rosters"].select("league_id", "roster_id", F.explode("players").alias("player_id"))


def q_silver_leagues_json(spark, sf):
    return _silver_json(spark, sf)["league"].select("league_id", "name")


def q_player_trend_texts(spark, sf):
    """F3 + F4 on texts: every line's quantity in spellings that only some number parsers accept."""
    configure(spark)
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber")
    text = F.when(n == 1, F.concat(q, F.lit("d"))).when(n == 2, F.concat(q, F.lit("F"))).when(n == 3, F.concat(q, F.lit("e1"))).otherwise(q)
    rows = roles.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", text.alias("age"))
    f = column_fields(rows)
    json = rows.select("*", F.parse_json(F.to_json(F.struct("age"))).alias("record_v"))
    return json.select(
        "l_orderkey", "l_linenumber", "l_suppkey", f("age").as_float().alias("typed"), json_fields()("age").as_float().alias("from_json"),
        json_fields()("age").as_int().alias("whole"),
    )


# --------------------------------------------------------------------------- SQL files
def _sql_views(spark, sf) -> dict[str, str]:
    views = {}
    for tbl in ("players", "rosters"):
        views[f"bronze_{tbl}_raw"] = f"bronze_{tbl}_raw_{uuid.uuid4().hex}"
        _records(spark, sf, tbl).createOrReplaceTempView(views[f"bronze_{tbl}_raw"])
    return views


def q_sql_bronze_players(spark, sf):
    b = sqlfiles.run_layer(spark, "bronze", ["players"], _sql_views(spark, sf))["players"]
    return b.select(*[F.col(f"t_{c}").alias(c) for c in roles.PLAYER_FIELDS], F.expr("variant_get(raw, '$.name', 'string')").alias("raw_name"))


def q_sql_silver_players(spark, sf):
    views = _sql_views(spark, sf)
    sqlfiles.run_layer(spark, "bronze", ["players"], views)
    return sqlfiles.run_layer(spark, "silver", ["players"], views)["players"].select(*_PLAYER_COLS)


def q_sql_available_players(spark, sf):
    out = sqlfiles.run_all(spark, _sql_views(spark, sf), store=scratch_path(spark, "silver"), league_id=LEAGUE)
    return out["gold_available_players"].select(*_OBJ_COLS)


# --------------------------------------------------------------------------- catalog, samples, runs
def q_catalog_bronze(spark, sf):
    configure(spark)
    rows = None
    for name in ("lineitem", "orders", "events"):
        r = bronze.records_from_dataframe(roles.table(spark, sf, name), "tpch", name)
        rows = r if rows is None else rows.unionByName(r)
    return bronze.catalog(rows)


def q_catalog_all(spark, sf):
    configure(spark)
    p, r = _p(spark, sf), _r(spark, sf)
    return cat.catalog_silver_gold(p, roles.silver_leagues(spark, sf), r)


def q_sample_table(spark, sf):
    return cat.sample(_p(spark, sf), SAMPLE_ROWS).select(*_PLAYER_COLS)


def q_latest_runs(spark, sf):
    """L3: newest 50 runs; the events table plays the run log. Equal times are ordered by event."""
    configure(spark)
    runs = roles.table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("league_id"), "ts", "event_id"
    )
    return newest_n(runs, "ts", RUN_HISTORY, ["event_id"]).drop("event_id")


def q_run_log(spark, sf):
    """G8 + L3 + F13: runs of all leagues in one call, then a broad one; the newest 50, and whether their time lies within the calls."""
    root = scratch_path(configure(spark), "runs")
    now = lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    start = now()
    cat.record_runs(spark, root, "league", roles.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("league_id"), "c_custkey"))
    cat.record_run(spark, root, "broad")
    timed = F.col("ts").between(F.lit(start), F.lit(now()))
    return cat.latest_runs(spark, root).select("kind", "league_id", "seq", timed.alias("timed"))


def q_catalog_full(spark, sf):
    """Bronze (from the commit log's counts; a table without rows included), silver and gold in one table."""
    s = _silver_json(spark, sf, sv.INJURY_COLUMNS)
    return cat.catalog_store(spark, _store(spark, sf), s["players"], s["league"], s["rosters"])


def q_catalog_incremental(spark, sf):
    """A6 + G5 from deltas: the store's records come to silver in three overlapping batches that are not in order of arrival."""
    root, silver = _store(spark, sf), scratch_path(configure(spark), "silver")

    def followed(tbl: str) -> dict[str, int]:
        rows = bronze.parsed_at(spark, root, _SRC, tbl)
        for without in (0, 2, 1):
            bs.merge(spark, f"{silver}/{tbl}", rows.where(F.pmod(F.xxhash64("_seq"), F.lit(3)) != without), tbl)
        return bs.counts(spark, f"{silver}/{tbl}", tbl)

    counts = {}
    with shuffles_dropped(spark), ThreadPoolExecutor(len(bs.KINDS)) as pool:  # each table has writers of its own
        for held in pool.map(followed, bs.KINDS):
            counts |= held
    return cat.catalog_incremental(spark, root, counts)


def q_leagues_missing_store(spark, sf):
    """J4 over a store: of as many league ids as there are parts, those without a roster in bronze, told from the key files."""
    root = _store(spark, sf)
    asked = roles.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("league_id"))
    return gold.leagues_missing(spark, bronze.keys(spark, root, _SRC, "rosters").select(F.col("key").alias("league_id")), asked)


def q_sample_bronze(spark, sf):
    """The first rows of a bronze table, by source and table."""
    rows = cat.sample_table({}, "bronze", _SRC, "players", bronze.scan(spark, _store(spark, sf)))
    f = json_fields()
    return bronze.parsed(rows).select(f("player_id").text().alias("player_id"), f("name").text().alias("name"), f("number").as_int().alias("number"))


def q_sample_named(spark, sf):
    """The first keys of each of the six named silver and gold datasets."""
    s, out = _silver_json(spark, sf, sv.INJURY_COLUMNS), None
    s["players"] = stored(s["players"], "players")  # four of the datasets are made of them
    data = cat.silver_gold_datasets(s["players"], s["league"], s["rosters"])
    for (layer, name), df in data.items():
        key = F.concat_ws("/", *[c for c in ("league_id", "roster_id", "player_id") if c in df.columns])
        part = cat.sample_table(data, layer, name).select(F.lit(layer).alias("layer"), F.lit(name).alias("name"), key.alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def q_injury_json(spark, sf):
    """the injury report as JSON texts, a null field left out."""
    report = gold.injury_report(_p(spark, sf), LEAGUE)
    # every second player's time is unknown
    unknown = F.col("player_id").cast("long") % 2 == 0
    return gold.to_json_lines(report.withColumn("updated_at", F.when(~unknown, F.col("updated_at"))))


def q_available_players_default(spark, sf):
    """A request without a league uses the configured one."""
    configure(spark).conf.set(gold.DEFAULT_LEAGUE_CONF, LEAGUE)
    try:
        return gold.available_players(_p(spark, sf), _r(spark, sf)).select(*_PLAYER_COLS)
    finally:
        spark.conf.unset(gold.DEFAULT_LEAGUE_CONF)


def q_all_players(spark, sf):
    """Every player, whatever league is configured."""
    return gold.available_players(_p(spark, sf), _r(spark, sf), gold.ALL_PLAYERS).select(*_PLAYER_COLS)


def q_parse_id_list(spark, sf):
    """F9 over free-text id lists derived from every order."""
    configure(spark)
    od = roles.table(spark, sf, "orders")
    text = F.concat(
        F.lit(" "), F.col("o_orderkey"), F.lit(" ,"), F.col("o_custkey"), F.lit("\n\n"), F.col("o_orderpriority"), F.lit(" ,,")
    )
    return od.select("o_orderkey", F.posexplode(parse_id_list(text)).alias("pos", "league_id"))


# --------------------------------------------------------------------------- sources
def q_src_fixture_events(spark, sf):
    """A DataFrame source poured into bronze rows, parsed back into its schema."""
    configure(spark)
    ev = roles.table(spark, sf, "events")
    rows = ing.ingest_dataframe(ev, "fixture", "events")
    return bronze.typed(rows, ev.schema).drop("_seq")


def q_src_generic(spark, sf):
    """A reader format + options poured into bronze rows, parsed back."""
    configure(spark)
    rows = ing.ingest_format(spark, "parquet", "generic", "orders", path=f"{sf}/orders.parquet")
    schema = roles.table(spark, sf, "orders").schema
    return bronze.typed(rows, schema).drop("_seq")


def q_src_map_snapshot(spark, sf):
    """A map snapshot of every part, landed as lines, ingested into bronze
    with the key injected as player_id, and read back."""
    configure(spark)
    root = scratch_path(spark, "landing")
    part = roles.table(spark, sf, "part")
    entry = F.struct(F.col("p_name").alias("display_name"), F.col("p_type").alias("position"), F.col("p_brand").alias("team"))
    part.select(F.to_json(F.create_map(F.col("p_partkey").cast("string"), entry))).write.text(f"{root}/players/0.jsonl")
    rows = landed.players_snapshot(spark, root, pattern="players/*.jsonl", whole=False)
    return bronze.typed(rows, "player_id string, display_name string, position string, team string").drop("_seq")


def q_src_map_document(spark, sf):
    """The snapshot of every part as one JSON document in one file, read in byte ranges."""
    configure(spark)
    root = scratch_path(spark, "landing")
    part = roles.table(spark, sf, "part")
    entry = F.to_json(F.struct(F.col("p_name").alias("display_name"), F.col("p_type").alias("position"), F.col("p_brand").alias("team")))
    rows = ranked(part.select("p_partkey", F.concat(F.lit('"'), "p_partkey", F.lit('": '), entry).alias("entry")), ["p_partkey"])
    last = rows.count() - 1
    line = F.concat(F.when(F.col("rank") == 0, "{").otherwise(""), "entry", F.when(F.col("rank") == last, "}").otherwise(","))
    rows.select("rank", line.alias("line")).coalesce(1).sortWithinPartitions("rank").select("line").write.text(f"{root}/players/all.json")
    found = landed.players_document(spark, root, pattern="players/all.json/part-*")
    return bronze.typed(found, "player_id string, display_name string, position string, team string").drop("_seq")


def _land(spark, sf, kind: str) -> str:
    """Payloads of all leagues, landed as lines; every tenth one is damaged, and every fiftieth line itself is cut off.

    A league's is its customer. Rosters and matchups are lists, one per order: of a damaged list either
    the text is cut off or one element is no object.
    """
    root = scratch_path(configure(spark), "landing")
    if kind == "league":
        t = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("n"), F.col("c_custkey").alias("league"), F.lit(1).alias("week"),
                                                      F.to_json(F.struct(F.col("c_name").alias("name"))).alias("payload"))
    else:
        od = roles.table(spark, sf, "orders")
        item = F.struct(F.col("o_orderkey").alias("roster_id" if kind == "rosters" else "matchup_id"), F.col("o_orderpriority").alias("note"))
        payload = F.concat(F.lit("["), F.when(F.col("o_orderkey") % 20 == 0, F.lit("17,")).otherwise(""), F.to_json(item), F.lit("]"))
        t = od.select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("league"), (F.col("o_orderkey") % 3).alias("week"), payload.alias("payload"))
    cut = F.expr("substring(payload, 1, length(payload) - 3)")
    t = t.withColumn("payload", F.when(F.col("n") % 10 == (3 if kind == "league" else 7), cut).otherwise(F.col("payload")))
    line = F.to_json(F.struct(F.col("league").cast("string").alias("league_id"), F.col("week"), F.col("payload")))
    t = t.select("n", line.alias("line"))
    t.select(F.when(F.col("n") % 50 == 11, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line"))).write.text(f"{root}/{kind}/0.jsonl")
    return root


def _leagues(spark, sf) -> DataFrame:
    return roles.table(spark, sf, "customer").select("c_custkey")


def q_src_league(spark, sf):
    """S6a + S8 + X5: league payloads; a damaged one keeps its text and is marked."""
    rows = landed.league_records(spark, _land(spark, sf, "league"), _leagues(spark, sf), lines=True)
    f = F.from_json("record", "league_id string, name string")
    return rows.select(F.when(~F.col("is_malformed"), f["league_id"]).alias("league_id"), F.when(~F.col("is_malformed"), f["name"]).alias("name"),
                       "is_malformed", F.when(F.col("is_malformed"), F.col("record")).alias("text"))


def _list_query(rows: DataFrame, key: str) -> DataFrame:
    f = F.from_json("record", f"league_id string, week bigint, {key} bigint, note string")
    good = ~F.col("is_malformed")
    return rows.select(*[F.when(good, f[c]).alias(c) for c in ("league_id", "week", key, "note")], "is_malformed",
                       F.when(~good, F.col("record")).alias("text"))


def q_src_rosters(spark, sf):
    """S6b + X5: roster payloads; damaged payloads and elements keep their text."""
    return _list_query(landed.roster_records(spark, _land(spark, sf, "rosters"), _leagues(spark, sf), lines=True), "roster_id")


def q_src_matchups(spark, sf):
    """S6c + X5: matchup payloads of week 1."""
    return _list_query(landed.matchup_records(spark, _land(spark, sf, "matchups"), _leagues(spark, sf), 1, lines=True), "matchup_id")


def q_quarantine_counts(spark, sf):
    """Rows and damaged rows of each landed table, written to a store and counted there."""
    root, ids = scratch_path(configure(spark), "store"), _leagues(spark, sf)
    bronze.append(landed.league_records(spark, _land(spark, sf, "league"), ids, lines=True), root)
    bronze.append(landed.roster_records(spark, _land(spark, sf, "rosters"), ids, lines=True), root)
    bronze.append(landed.matchup_records(spark, _land(spark, sf, "matchups"), ids, 1, lines=True), root)
    return bronze.quarantine_counts(bronze.scan(spark, root)).select(F.col("tbl").alias("name"), "row_count", "malformed_count")


def _event_lines(spark, sf, path: str) -> DataFrame:
    ev = roles.table(configure(spark), sf, "events")
    ev.select(F.to_json(F.struct(*ev.columns), bronze.JSON_OPTIONS)).write.text(path)
    return ev


def q_jsonl_load(spark, sf):
    """JSON Lines files into bronze rows."""
    path = scratch_path(configure(spark), "lines")
    ev = _event_lines(spark, sf, path)
    return bronze.typed(bronze.read_jsonl(spark, path, "fixture", "events"), ev.schema).drop("_seq")


def q_jsonl_tree(spark, sf):
    """A tree of JSON Lines files, loaded in one scan; rows per table."""
    root = scratch_path(configure(spark), "tree")
    _event_lines(spark, sf, f"{root}/fixture/events.jsonl")
    od = roles.table(spark, sf, "orders")
    od.select(F.to_json(F.struct(*od.columns))).write.text(f"{root}/tpch/orders.jsonl")
    return bronze.catalog(bronze.read_jsonl_tree(spark, root))


def q_src_datasource(spark, sf):
    """A source written in Python, registered and read by name."""
    path = scratch_path(configure(spark), "lines")
    ev = _event_lines(spark, sf, path)
    name = ing.register_datasource(spark, JsonLineFiles)
    rows = bronze.records_from_json_column(ing.get_source(name)(spark, path=path), "record", "python", "events")
    return bronze.typed(rows, ev.schema).drop("_seq")


def q_src_datasource_write(spark, sf):
    """Events written by the Python source's writer, read back in ranges of a quarter megabyte."""
    path = scratch_path(configure(spark), "lines")
    ev = roles.table(spark, sf, "events")
    name = ing.register_datasource(spark, JsonLineFiles)
    ev.select(F.to_json(F.struct(*ev.columns), bronze.JSON_OPTIONS).alias("record")).write.format(name).mode("append").save(path)
    rows = bronze.records_from_json_column(ing.get_source(name)(spark, path=path, splitBytes=1 << 18), "record", "python", "events")
    return bronze.typed(rows, ev.schema).drop("_seq")


def _land_lines(lines: DataFrame, path: str) -> None:
    """Land a large table's lines, in their order."""
    with shuffles_dropped(lines.sparkSession):
        lines.write.mode("append").options(**landed.LANDED_TEXT).text(path)


def q_pipeline_run(spark, sf):
    """Q5 + S7 + G9: land players, leagues and rosters; ingest, conform, and ask for a league's available players."""
    at_least_partitions(configure(spark), roles.partitions(spark, sf))
    root, store = scratch_path(spark, "landing"), scratch_path(spark, "store")
    recs = roles.player_records(spark, sf, ordered=True).withColumn("updated_at", F.col("updated_at").cast("string"))
    fields = [c for c in roles.PLAYER_FIELDS if c != "player_id"]
    _land_lines(recs.select(F.to_json(F.create_map(F.col("player_id").cast("string"), F.struct(*fields)))), f"{root}/players/0.jsonl")
    ro = _snapshots(spark, sf).orderBy("_seq.s1", "roster_id")
    payload = F.to_json(F.array(F.struct("roster_id", "players")))
    _land_lines(ro.select(F.to_json(F.struct(F.col("league_id").cast("string").alias("league_id"), payload.alias("payload")))), f"{root}/rosters/0.jsonl")
    out = pipeline.run(spark, root, store, ", ".join(REQUESTED), league_id=LEAGUE)
    return out["available_players"].select(*_OBJ_COLS)


def q_bronze_roundtrip(spark, sf):
    """S9 + S10: append events to a bronze store in the checkpoint folder, scan them back."""
    configure(spark)
    root = scratch_path(spark, "bronze")
    ev = roles.table(spark, sf, "events")
    bronze.append(bronze.records_from_dataframe(ev, "fixture", "events"), root, [("fixture", "events")])
    return bronze.typed(bronze.scan(spark, root, "fixture", "events"), ev.schema).drop("_seq")


def q_bronze_compacted(spark, sf):
    """S9 + S10: eight writers append their share of the events at once; compacted; every row read back."""
    root = scratch_path(configure(spark), "bronze")
    ev = roles.table(spark, sf, "events")
    share = lambda i: ev.where(F.pmod(F.xxhash64("event_id"), F.lit(8)) == i)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: bronze.append(bronze.records_from_dataframe(share(i), "fixture", "events"), root), range(8)))
    bronze.compact(spark, root)
    return bronze.typed(bronze.scan(spark, root, "fixture", "events"), ev.schema).drop("_seq")


def _replay_last_batch(spark, checkpoint: str) -> None:
    """As after a crash between a micro-batch's work and its entry in the checkpoint: the next start runs it again."""
    done = f"{checkpoint}/commits"
    files.remove(spark, f"{done}/{max((n for n in files.names(spark, done) if n.isdigit()), key=int)}")


def q_stream_bronze(spark, sf):
    """Events land in two parts; the stream is started for each, and once more with its last micro-batch repeated."""
    configure(spark)
    land, root, ck = (scratch_path(spark, n) for n in ("landing", "store", "checkpoint"))
    ev = roles.table(spark, sf, "events")
    for part in (0, 1):
        ev.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).select(F.to_json(F.struct(*ev.columns), bronze.JSON_OPTIONS)).write.mode("append").text(land)
        bs.stream_to_bronze(spark, land, root, "fixture", "events", checkpoint=ck).awaitTermination()
    _replay_last_batch(spark, ck)
    bs.stream_to_bronze(spark, land, root, "fixture", "events", checkpoint=ck).awaitTermination()
    return bronze.typed(bronze.scan(spark, root, "fixture", "events"), ev.schema).drop("_seq")


def q_stream_silver(spark, sf):
    """X1 + X2: player records land in three parts by date; silver follows each of them, with both streams' last micro-batch repeated."""
    configure(spark)
    at_least_partitions(spark, roles.partitions(spark, sf))
    land, root, silver, ck = (scratch_path(spark, n) for n in ("landing", "store", "silver", "checkpoint"))
    recs = roles.player_records(spark, sf, ordered=True)
    day = F.col("_seq.s1")
    for part in (day < "1994-01-01", (day >= "1994-01-01") & (day < "1996-07-01"), (day >= "1996-07-01") | day.isNull()):
        rows = recs.where(part).withColumn("updated_at", F.col("updated_at").cast("string"))
        _land_lines(rows.select(F.to_json(F.struct(*roles.PLAYER_FIELDS))), land)
        bs.stream_to_bronze(spark, land, root, _SRC, "players", checkpoint=f"{ck}/bronze").awaitTermination()
        bs.incremental_silver(spark, root, silver, checkpoint=f"{ck}/silver").awaitTermination()
        _replay_last_batch(spark, f"{ck}/bronze")
        _replay_last_batch(spark, f"{ck}/silver")
    bs.stream_to_bronze(spark, land, root, _SRC, "players", checkpoint=f"{ck}/bronze").awaitTermination()
    bs.incremental_silver(spark, root, silver, checkpoint=f"{ck}/silver").awaitTermination()
    return bs.read_current(spark, silver).select(*_PLAYER_COLS)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "available_players": q_available_players,
    "gold_available_players": q_gold_available_players,
    "sql_available_players": q_sql_available_players,
    "silver_players": q_silver_players,
    "silver_players_window": q_silver_players_window,
    "sql_silver_players": q_sql_silver_players,
    "sql_bronze_players": q_sql_bronze_players,
    "silver_rosters": q_silver_rosters,
    "silver_leagues": q_silver_leagues,
    "silver_matchups": q_silver_matchups,
    "league_lookup": q_league_lookup,
    "silver_injuries": q_silver_injuries,
    "gold_injury_report": q_gold_injury_report,
    "rostered_player_ids": q_rostered_player_ids,
    "rosters_for_league": q_rosters_for_league,
    "lineitem_latest": q_lineitem_latest,
    "latest_event_per_user": q_latest_event_per_user,
    "first_seen_players": q_first_seen_players,
    "gold_league_validation": q_gold_league_validation,
    "leagues_missing": q_leagues_missing,
    "gold_waiver": q_gold_waiver,
    "gold_waiver_by_score": q_gold_waiver_by_score,
    "waiver_all_leagues": q_waiver_all_leagues,
    "waiver_all_leagues_by_score": q_waiver_all_leagues_by_score,
    "available_all_leagues": q_available_all_leagues,
    "available_expanded": q_available_expanded,
    "catalog_bronze": q_catalog_bronze,
    "catalog_all": q_catalog_all,
    "sample_table": q_sample_table,
    "latest_runs": q_latest_runs,
    "parse_id_list": q_parse_id_list,
    "src_fixture_events": q_src_fixture_events,
    "src_generic": q_src_generic,
    "bronze_roundtrip": q_bronze_roundtrip,
    "src_map_snapshot": q_src_map_snapshot,
    "src_map_document": q_src_map_document,
    "silver_players_json": q_silver_players_json,
    "silver_rosters_json": q_silver_rosters_json,
    "silver_leagues_json": q_silver_leagues_json,
    "player_trend_texts": q_player_trend_texts,
    "run_log": q_run_log,
    "catalog_full": q_catalog_full,
    "catalog_incremental": q_catalog_incremental,
    "sample_bronze": q_sample_bronze,
    "sample_named": q_sample_named,
    "injury_json": q_injury_json,
    "available_players_default": q_available_players_default,
    "all_players": q_all_players,
    "src_league": q_src_league,
    "src_rosters": q_src_rosters,
    "src_matchups": q_src_matchups,
    "quarantine_counts": q_quarantine_counts,
    "jsonl_load": q_jsonl_load,
    "jsonl_tree": q_jsonl_tree,
    "src_datasource": q_src_datasource,
    "src_datasource_write": q_src_datasource_write,
    "pipeline_run": q_pipeline_run,
    "leagues_missing_store": q_leagues_missing_store,
    "bronze_compacted": q_bronze_compacted,
    "stream_bronze": q_stream_bronze,
    "stream_silver": q_stream_silver,
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: players available in league 7 (scan, conform, dedup on one and
    two keys, array explode, anti-join, projection)."""
    return q_gold_available_players(spark, SMOKE_DIR)


try:  # the training-data operators are a part that can be left out
    from ingot.llm import queries as _llm
except ModuleNotFoundError as e:
    if e.name not in ("ingot.llm", "corpus_pipeline"):  # whatever else is missing is a fault
        raise
    _llm = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **(_llm.queries() if _llm else {})}


# =========================================================================== oracles (DuckDB)
_BZ_PLAYERS = """bz_players AS (
  select l_partkey as player_id, l_shipdate as s1, l_orderkey as s2, l_linenumber as s3, l_suppkey as s4,
    case when l_returnflag='N' then '' when l_returnflag='R' then null else 'P'||l_suppkey end as display_name,
    'L'||l_linenumber as name, l_returnflag as position,
    case when l_linestatus='O' then null else 'T'||(l_suppkey%32) end as team,
    case when l_quantity<10 then 'Active' when l_quantity<20 then '' else 'Inactive' end as status,
    case when l_linenumber=1 then 'Out' when l_linenumber=2 then '' when l_linenumber=3 then 'Active' end as injury_status,
    case when l_linenumber=5 then 'n/a' else cast(cast(l_quantity as int) as varchar) end as age,
    case when l_linenumber=6 then null else l_discount end as trending, l_shipdate as updated_at
  from lineitem)"""

_SV_PLAYERS = """sv_players AS (
  select cast(player_id as varchar) as player_id,
    coalesce(nullif(display_name,''), nullif(name,''), '') as name,
    coalesce(position,'') as position, coalesce(team,'') as team, coalesce(status,'') as status,
    coalesce(injury_status,'') as injury_status, try_cast(age as bigint) as age,
    cast(trending as double) as trending, cast(updated_at as varchar) as updated_at, first_k
  from (select *, min((s1,s2,s3,s4)) over (partition by player_id) as first_k from bz_players
        where player_id is not null and player_id <> 0)
  qualify row_number() over (partition by player_id order by s1 desc, s2 desc, s3 desc, s4 desc) = 1)"""

_BZ_ROSTERS = """bz_rosters AS (
  select o_custkey as league_id, l_orderkey as roster_id, l_shipdate as seq, list(cast(l_partkey as varchar)) as players
  from lineitem join orders on l_orderkey = o_orderkey group by all)"""

_SV_ROSTERS = """sv_rosters AS (
  select cast(league_id as varchar) as league_id, cast(roster_id as varchar) as roster_id, players
  from bz_rosters qualify row_number() over (partition by league_id, roster_id order by seq desc) = 1)"""

_GD_AVAIL = f"""gd_avail AS (
  select p.* from sv_players p
  anti join (select unnest(players) as player_id from sv_rosters where league_id = '{LEAGUE}') r using (player_id))"""

_GD_INJURY = """gd_injury AS (
  select player_id, coalesce(nullif(injury_status,''), nullif(status,''), '') as status, updated_at from sv_players
  where coalesce(nullif(injury_status,''), nullif(status,''), '') not in ('', 'Active'))"""

# a league id of 0 is falsy and dropped, as in the reference
_SV_LEAGUES = """sv_leagues AS (select cast(c_custkey as varchar) as league_id, c_name as name from customer where c_custkey <> 0)"""

_REQ = "(select unnest(['1','7','999999']) as league_id)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_P = _with(_BZ_PLAYERS, _SV_PLAYERS)
_PR = _with(_BZ_PLAYERS, _SV_PLAYERS, _BZ_ROSTERS, _SV_ROSTERS)
_PRA = _with(_BZ_PLAYERS, _SV_PLAYERS, _BZ_ROSTERS, _SV_ROSTERS, _GD_AVAIL)
_R = _with(_BZ_ROSTERS, _SV_ROSTERS)
_PCOLS = ", ".join(_PLAYER_COLS)
_OCOLS = "player_id as id, player_id, name, position, team, status, age, trending"


def _line(league: str, week: str, payload: str) -> str:
    """A landed line."""
    quoted = f"""replace({payload}, '"', chr(92) || '"')"""
    return f"""'{{"league_id":"' || {league} || '","week":' || {week} || ',"payload":"' || {quoted} || '"}}'"""


def _list_oracle(key: str, where: str) -> str:
    """Orders as landed lists: one object each, a stray number before it in some; some lists and some lines are cut off."""
    week = "1::bigint" if key == "matchup_id" else "null::bigint"
    line = _line("o_custkey", "o_orderkey % 3", "case when cut then left(list, length(list) - 3) else list end")
    return f"""with o as (select *, o_orderkey % 10 = 7 as cut, o_orderkey % 50 = 11 as torn,
          '{{"{key}":' || o_orderkey || ',"note":"' || o_orderpriority || '"}}' as item,
          '[' || case when o_orderkey % 20 = 0 then '17,' else '' end || item || ']' as list
        from orders), p as (select *, {line} as line, cut or torn as bad from o where ({where}) or torn)
      select case when not bad then o_custkey::varchar end as league_id, case when not bad then {week} end as week,
        case when not bad then o_orderkey end as {key}, case when not bad then o_orderpriority end as note, bad as is_malformed,
        case when torn then left(line, length(line) - 3) when cut then left(list, length(list) - 3) end as text from p
      union all select null, null, null, null, true, '17' from p where o_orderkey % 20 = 0 and not bad"""


# Every league's excluded players by their place in ``sv_players``; the free places are what is left of the first n of all.
def _waiver_oracle(order: str) -> str:
    ctes = f"""rk AS (select *, coalesce(trending, 0.0) as score, row_number() over (order by {order}) - 1 as rank from sv_players),
ex AS (select distinct league_id, rank from (select league_id, unnest(players) as player_id from sv_rosters) join rk using (player_id)),
top AS (select l.league_id, k.* from sv_leagues l, rk k where k.rank < 5 + (select coalesce(max(n), 0) from (select count(*) as n from ex group by league_id))),
fr AS (select * from top anti join ex using (league_id, rank) qualify row_number() over (partition by league_id order by rank) <= 5)"""
    return _with(_BZ_PLAYERS, _SV_PLAYERS, _BZ_ROSTERS, _SV_ROSTERS, _SV_LEAGUES, ctes) + """select league_id,
        (row_number() over (partition by league_id order by rank) - 1)::int as place, player_id, name, position, team, score from fr"""


_AVAILABLE_ALL = """rk AS (select *, row_number() over (order by first_k) - 1 as rank from sv_players),
ex AS (select distinct league_id, rank from (select league_id, unnest(players) as player_id from sv_rosters) join rk using (player_id)),
bm AS (select league_id, 1 + rank // 32768 as bucket, count(*) as n,
  sha256(bitstring_agg((rank % 32768 // 8 * 8 + 7 - rank % 8)::int, 0, 32767)::blob) as bits from ex group by all),
lg AS (select league_id, sum(n) as n, string_agg(bucket || ':' || bits, ',' order by bucket) as lines from bm group by all)"""


_ORACLES: dict[str, str] = {
    "waiver_all_leagues": _waiver_oracle("first_k"),
    "waiver_all_leagues_by_score": _waiver_oracle("coalesce(trending, 0.0) desc, first_k"),
    "available_all_leagues": _with(_BZ_PLAYERS, _SV_PLAYERS, _BZ_ROSTERS, _SV_ROSTERS, _SV_LEAGUES, _AVAILABLE_ALL)
    + """select l.league_id, ((select count(*) from sv_players) - coalesce(n, 0))::bigint as n_available, coalesce(n, 0)::bigint as n_excluded,
        sha256(coalesce(lines, '')) as digest from sv_leagues l left join lg using (league_id)""",
    "available_expanded": _PRA + f"select {_PCOLS} from gd_avail",
    "available_players": _PRA + f"select {_PCOLS} from gd_avail",
    "gold_available_players": _PRA + f"select {_OCOLS} from gd_avail",
    "sql_available_players": _PRA + f"select {_OCOLS} from gd_avail",
    "silver_players": _P + f"select {_PCOLS} from sv_players",
    "silver_players_window": _P + f"select {_PCOLS} from sv_players",
    "sql_silver_players": _P + f"select {_PCOLS} from sv_players",
    "sql_bronze_players": _with(_BZ_PLAYERS)
    + """select cast(player_id as varchar) as player_id, display_name, name, position, team, status, injury_status, age,
        regexp_replace(cast(trending as varchar), '\\.0$', '') as trending, cast(updated_at as varchar) as updated_at,
        cast(s3 as varchar) as number, name as raw_name from bz_players""",
    "silver_rosters": _R + "select league_id, roster_id, unnest(players) as player_id from sv_rosters",
    "silver_leagues": _with(_SV_LEAGUES) + "select league_id, name from sv_leagues",
    "silver_matchups": """select o_custkey::varchar as league_id, l_linenumber::bigint as week,
        case when l_linenumber <> 7 then (l_orderkey % 6)::varchar end as matchup_id, l_orderkey::varchar as roster_id,
        case when l_linenumber <> 5 then l_quantity::double end as points from lineitem join orders on l_orderkey = o_orderkey
        qualify row_number() over (partition by o_custkey, l_linenumber, l_orderkey order by l_shipdate desc, l_partkey desc, l_suppkey desc) = 1""",
    "league_lookup": _with(_SV_LEAGUES) + f"select league_id, name from sv_leagues where league_id = '{LEAGUE}'",
    "silver_injuries": _with(_BZ_PLAYERS, _SV_PLAYERS, _GD_INJURY) + "select player_id, status, updated_at from gd_injury",
    "gold_injury_report": _with(_BZ_PLAYERS, _SV_PLAYERS, _GD_INJURY) + "select player_id, status, updated_at from gd_injury",
    "rostered_player_ids": _R + "select distinct league_id, unnest(players) as player_id from sv_rosters",
    "rosters_for_league": _R + f"select roster_id, unnest(players) as player_id from sv_rosters where league_id = '{LEAGUE}'",
    "lineitem_latest": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate from lineitem
        qualify row_number() over (partition by l_orderkey, l_linenumber
                                   order by l_shipdate desc, l_partkey desc, l_suppkey desc) = 1""",
    "latest_event_per_user": """select user_id, event_type, value, ts from events
        qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
    "first_seen_players": _P + "select player_id from sv_players order by first_k limit 20",
    "gold_league_validation": _with(_SV_LEAGUES)
    + f"""select q.league_id, l.league_id is not null as valid, coalesce(l.name, '') as league_name
        from {_REQ} q left join sv_leagues l on l.league_id = q.league_id""",
    "leagues_missing": _with(_BZ_ROSTERS)
    + f"""select q.league_id from {_REQ} q
        anti join (select distinct cast(league_id as varchar) as league_id from bz_rosters) b using (league_id)""",
    "gold_waiver": _PRA
    + "select player_id, name, position, team, coalesce(trending, 0.0) as score from gd_avail order by first_k limit 20",
    "gold_waiver_by_score": _PRA
    + """select player_id, name, position, team, coalesce(trending, 0.0) as score from gd_avail
        order by score desc, first_k limit 20""",
    "catalog_bronze": """select 'bronze' as layer, 'tpch' as source_id, 'lineitem' as name, count(*) as row_count from lineitem
        union all select 'bronze', 'tpch', 'orders', count(*) from orders
        union all select 'bronze', 'tpch', 'events', count(*) from events""",
    "catalog_all": _with(_BZ_PLAYERS, _SV_PLAYERS, _BZ_ROSTERS, _SV_ROSTERS, _GD_INJURY, _SV_LEAGUES)
    + """select 'silver' as layer, 'players' as name, count(*) as row_count from sv_players
        union all select 'silver', 'league', count(*) from sv_leagues
        union all select 'silver', 'rosters', count(*) from sv_rosters
        union all select 'silver', 'injuries', count(*) from gd_injury
        union all select 'gold', 'available_players', count(*) from sv_players
        union all select 'gold', 'injury', count(*) from gd_injury""",
    "sample_table": _P + f"select {_PCOLS} from sv_players order by first_k limit 100",
    "latest_runs": """select event_type as kind, cast(user_id as varchar) as league_id, ts from events
        order by ts desc, event_id desc limit 50""",
    "parse_id_list": """select o_orderkey, pos - 1 as pos, league_id from (
        select o_orderkey, unnest(ids) as league_id, generate_subscripts(ids, 1) as pos from (
          select o_orderkey, list_filter(list_transform(
              regexp_split_to_array(' ' || o_orderkey || ' ,' || o_custkey || chr(10) || chr(10) || o_orderpriority || ' ,,', '[,\n]'),
              lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ids from orders))""",
    "src_fixture_events": "select * from events",
    "src_generic": "select * from orders",
    "bronze_roundtrip": "select * from events",
    "silver_players_json": _P + f"select {_PCOLS} from sv_players",
    "silver_rosters_json": _R + "select league_id, roster_id, unnest(players) as player_id from sv_rosters",
    "silver_leagues_json": _with(_SV_LEAGUES) + "select league_id, name from sv_leagues",
    "player_trend_texts": """select l_orderkey, l_linenumber, l_suppkey, n as typed, n as from_json,
        case when l_linenumber > 3 then cast(l_quantity as int)::bigint end as whole
        from (select *, case when l_linenumber > 3 then cast(l_quantity as int)::double
          when l_linenumber = 3 then 10.0 * cast(l_quantity as int) end as n from lineitem)""",
    "run_log": """select 'broad' as kind, null::varchar as league_id, 0::bigint as seq, true as timed
        union all (select 'league', c_custkey::varchar, row_number() over (order by c_custkey) - 1 as seq, true from customer order by seq desc limit 49)""",
    "leagues_missing_store": _with(_BZ_ROSTERS) + "select p_partkey::varchar as league_id from part anti join bz_rosters on p_partkey = league_id",
    "bronze_compacted": "select * from events",
    "stream_bronze": "select * from events",
    "stream_silver": _P + f"select {_PCOLS} from sv_players",
    "catalog_full": _with(_BZ_PLAYERS, _SV_PLAYERS, _BZ_ROSTERS, _SV_ROSTERS, _GD_INJURY, _SV_LEAGUES)
    + """select 'bronze' as layer, 'league_api' as source_id, 'players' as name, count(*) as row_count from lineitem
        union all select 'bronze', 'league_api', 'rosters', count(*) from bz_rosters
        union all select 'bronze', 'league_api', 'league', 2 * count(*) from customer
        union all select 'bronze', 'league_api', 'matchups', 0
        union all select 'silver', null, 'players', count(*) from sv_players
        union all select 'silver', null, 'league', count(*) from sv_leagues
        union all select 'silver', null, 'rosters', count(*) from sv_rosters
        union all select 'silver', null, 'injuries', count(*) from gd_injury
        union all select 'gold', null, 'available_players', count(*) from sv_players
        union all select 'gold', null, 'injury', count(*) from gd_injury""",
    "sample_bronze": _with(_BZ_PLAYERS)
    + """select cast(player_id as varchar) as player_id, name, s3::bigint as number from bz_players order by s1, s2, s3, s4 limit 100""",
    "sample_named": _with(_BZ_PLAYERS, _SV_PLAYERS, _BZ_ROSTERS, _SV_ROSTERS, _GD_INJURY, _SV_LEAGUES)
    + """, f as (select player_id, first_k from sv_players), i as (select player_id, first_k from f where player_id in (select player_id from gd_injury)),
        r as (select cast(league_id as varchar) || '/' || cast(roster_id as varchar) as key, min((seq, roster_id)) as k from bz_rosters group by all)
        select * from (select 'silver' as layer, 'players' as name, player_id as key from f order by first_k limit 100)
        union all select * from (select 'gold', 'available_players', player_id from f order by first_k limit 100)
        union all select * from (select 'silver', 'injuries', player_id from i order by first_k limit 100)
        union all select * from (select 'gold', 'injury', player_id from i order by first_k limit 100)
        union all select * from (select 'silver', 'league', league_id from sv_leagues order by league_id::bigint limit 100)
        union all select * from (select 'silver', 'rosters', key from r order by k limit 100)""",
    "injury_json": _with(_BZ_PLAYERS, _SV_PLAYERS, _GD_INJURY)
    + """select '{"player_id":"' || player_id || '","status":"' || status || '"' || case when player_id::bigint % 2 <> 0 and updated_at is not null
        then ',"updated_at":"' || updated_at || '"' else '' end || '}' as value from gd_injury""",
    "available_players_default": _PRA + f"select {_PCOLS} from gd_avail",
    "all_players": _P + f"select {_PCOLS} from sv_players",
    "src_league": f"""select case when not bad then c_custkey::varchar end as league_id, case when not bad then c_name end as name, bad as is_malformed,
        case when torn then left(line, length(line) - 3) when bad then left(t, length(t) - 3) end as text
        from (select *, c_custkey % 50 = 11 as torn, torn or c_custkey % 10 = 3 as bad, '{{"name":"' || c_name || '"}}' as t,
          {_line("c_custkey", "1", "case when c_custkey % 10 = 3 then left(t, length(t) - 3) else t end")} as line from customer)""",
    "src_rosters": _list_oracle("roster_id", "true"),
    "src_matchups": _list_oracle("matchup_id", "o_orderkey % 3 = 1"),
    "quarantine_counts": """with o as (select *, o_orderkey % 50 = 11 as torn, o_orderkey % 10 = 7 as cut, o_orderkey % 20 = 0 as stray from orders)
        select 'league' as name, count(*) as row_count, count(*) filter (c_custkey % 10 = 3 or c_custkey % 50 = 11)::bigint as malformed_count from customer
        union all select 'rosters', count(*) + count(*) filter (stray), (count(*) filter (cut or torn) + count(*) filter (stray))::bigint from o
        union all select 'matchups', count(*) + count(*) filter (stray),
          (count(*) filter (cut or torn) + count(*) filter (stray))::bigint from o where o_orderkey % 3 = 1 or torn""",
    "jsonl_load": "select * from events",
    "jsonl_tree": """select 'bronze' as layer, 'fixture' as source_id, 'events' as name, count(*) as row_count from events
        union all select 'bronze', 'tpch', 'orders', count(*) from orders""",
    "src_datasource": "select * from events",
    "src_datasource_write": "select * from events",
    # the landed key is text, so player '0' is truthy and stays
    "pipeline_run": _with(_BZ_PLAYERS, _SV_PLAYERS.replace(" and player_id <> 0", ""), _BZ_ROSTERS, _SV_ROSTERS, _GD_AVAIL) + f"select {_OCOLS} from gd_avail",
    "src_map_document": """select cast(p_partkey as varchar) as player_id, p_name as display_name, p_type as position,
        p_brand as team from part""",
    "src_map_snapshot": """select cast(p_partkey as varchar) as player_id, p_name as display_name, p_type as position,
        p_brand as team from part""",
}

_ORACLES["catalog_incremental"] = _ORACLES["catalog_full"]


def oracle_sql() -> dict[str, str]:
    own = {k: v for k, v in _ORACLES.items() if k in _QUERIES}
    return {**own, **(_llm.oracle_sql() if _llm else {})}
