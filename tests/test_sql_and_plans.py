"""SQL files (Q1-Q5, G7) agree with the DataFrame forms; plan shape assertions."""

import pytest

from ingot.functions.expr import json_fields
from ingot.plans import gold, roles, sqlfiles
from ingot.plans import silver as sv

from conftest import SF001, bronze_records

RECS = [
    {"player_id": "p1", "display_name": "", "name": "One", "age": "25", "trending": "1.5"},
    {"player_id": 0, "name": "zero"},
    {"player_id": None, "id": 3, "display_name": "Three", "position": 0},
    {"player_id": "p1", "display_name": "One v2", "updated_at": "", "injury_updated": "d"},
    {"player_id": "p4", "status": "Out", "team": False, "age": 25.9},
]


def test_layer_errors(spark):
    assert sqlfiles.LAYERS == ("bronze", "silver", "gold")
    with pytest.raises(FileNotFoundError):
        sqlfiles.run_sql(spark, "gold", "nope")
    with pytest.raises(ValueError):
        sqlfiles.run_layer(spark, "platinum")


def test_sql_silver_players_equals_dataframe_form(spark):
    b = bronze_records(spark, RECS)
    b.createOrReplaceTempView("bronze_players_raw")
    sqlfiles.run_layer(spark, "bronze", ["players"])
    via_sql = sqlfiles.run_layer(spark, "silver", ["players"])["players"]
    via_df = sv.players(b, json_fields())
    cols = list(sv.public(via_df).columns) + ["_first_seq"]
    assert via_sql.select(*cols).exceptAll(via_df.select(*cols)).count() == 0
    assert via_df.select(*cols).exceptAll(via_sql.select(*cols)).count() == 0
    assert via_df.count() == 3


def test_sql_available_players_equals_dataframe_form(spark):
    bp = bronze_records(spark, RECS)
    br = bronze_records(spark, [{"league_id": "L1", "roster_id": 1, "players": ["p1"]}])
    bp.createOrReplaceTempView("bronze_players_raw")
    br.createOrReplaceTempView("bronze_rosters_raw")
    out = sqlfiles.run_all(spark, league_id="L1")
    got = sorted(r.id for r in out["gold_available_players"].collect())
    df = gold.gold_available_players(sv.players(bp), sv.rosters(br), "L1")
    assert got == sorted(r.id for r in df.collect()) == ["3", "p4"]
    out_all = sqlfiles.run_all(spark, league_id="")
    assert out_all["gold_available_players"].count() == 3


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_have_views_of_their_own(spark):
    def raw(ids):
        views = {}
        for name, recs in (("players", [{"player_id": i} for i in ids]), ("rosters", [{"league_id": "L", "roster_id": 1, "players": ids[:1]}])):
            views[f"bronze_{name}_raw"] = f"raw_{name}_{'_'.join(ids)}"
            bronze_records(spark, recs).createOrReplaceTempView(views[f"bronze_{name}_raw"])
        return views

    one = sqlfiles.run_all(spark, raw(["a", "b"]), league_id="L")["gold_available_players"]
    two = sqlfiles.run_all(spark, raw(["c", "d", "e"]), league_id="L")["gold_available_players"]
    assert [r.id for r in one.collect()] == ["b"] and sorted(r.id for r in two.collect()) == ["d", "e"]


def test_building_gold_starts_no_job_and_the_filter_reaches_the_scan(spark):
    p = roles.silver_players(spark, SF001)
    r = roles.silver_rosters(spark, SF001)
    sc = spark.sparkContext
    sc.setJobGroup("gold-build", "")
    plan = _plan(gold.available_players(p, r, "7"))
    gold.gold_available_players(p, r, "7"), gold.waiver_recommendations(p, r, "7"), gold.injury_report(p)
    assert list(sc.statusTracker().getJobIdsForGroup("gold-build")) == []
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert "LeftAnti" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # the league filter sits on the orders scan, below the latest-wins aggregate
    explain = gold.available_players(p, r, "7")._jdf.queryExecution().optimizedPlan().toString()
    agg_pos = explain.find("Aggregate [o_custkey")
    assert agg_pos != -1 and explain.find("o_custkey", agg_pos + 30) != -1
    assert "= 7)" in explain[agg_pos:]


def test_latest_wins_has_partial_aggregate(spark):
    plan = _plan(roles.silver_players(spark, SF001))
    assert plan.count("SortAggregate") + plan.count("HashAggregate") + plan.count("ObjectHashAggregate") >= 2
    assert "partial_max_by" in _plan(roles.silver_players(spark, SF001)) or "partial_max_by" in (
        roles.silver_players(spark, SF001)._jdf.queryExecution().executedPlan().treeString()
    )


def test_scan_prunes_columns(spark):
    df = roles.silver_players(spark, SF001).select("player_id")
    plan = df._jdf.queryExecution().executedPlan().treeString()
    assert "l_extendedprice" not in plan and "l_tax" not in plan


def test_lookup_join_broadcasts_requested_side(spark):
    lg = roles.silver_leagues(spark, SF001)
    plan = _plan(gold.validate_leagues(spark, lg, ["1", "7"]))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    # a request of unknown size is not hinted
    many = lg.select("league_id").limit(3)
    assert "LeftOuter" in _plan(gold.validate_leagues(spark, lg, many))
