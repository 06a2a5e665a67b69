"""Answers for all leagues at once (X3, X4): ranks, gaps, bitmaps."""

import random

import pytest
from pyspark.sql import functions as F

from ingot.operators.ranking import first_free, ranked
from ingot.plans import gold, leagues
from ingot.session import stored


def test_ranked_without_and_with_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = {r["i"]: r["rank"] for r in ranked(df, ["x", "i"]).collect()}
    assert got == {r[2]: k for k, r in enumerate(sorted(rows, key=lambda r: r[1:]))}
    got = {r["i"]: r["rank"] for r in ranked(df, [F.col("x").desc(), "i"], ["g"]).collect()}
    want = {}
    for g in ("hot", "a", "b", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: k for k, r in enumerate(mine)}
    assert got == want
    assert ranked(df.limit(0), ["x"], ["g"]).count() == 0


def test_first_free(spark):
    taken = {"all": range(100), "none": [], "gaps": [0, 1, 3, 7, 8], "late": [50, 51], "one": [0]}
    df = spark.createDataFrame([(g, r) for g, rs in taken.items() for r in rs], "g string, rank long")
    groups = spark.createDataFrame([(g,) for g in taken], "g string")
    got = {}
    for r in first_free(df, groups, "g", 6).orderBy("place").collect():
        got.setdefault(r["g"], []).append(r["rank"])
    assert got == {g: [x for x in range(200) if x not in set(rs)][:6] for g, rs in taken.items()}
    assert first_free(df, groups, "g", 0).count() == 0


@pytest.fixture(scope="module")
def world(spark):
    """900 players, 40 leagues; league L0 holds a third of all rosters and 800 players; some rostered ids are no players."""
    rng = random.Random(7)
    players = spark.createDataFrame(
        [(f"p{i}", f"N{i}", "WR", "KC", "", "", None, None if i % 5 == 0 else float(i * 37 % 101), None, i) for i in range(900)],
        "player_id string, name string, position string, team string, status string, injury_status string, age long, trending double, updated_at string, _first_seq int",
    )
    rosters = [("L0", f"r{k}", [f"p{rng.randrange(800)}" for _ in range(40)]) for k in range(60)]
    rosters += [(f"L{1 + k % 38}", f"r{k}", [f"p{min(int(rng.expovariate(0.02)), 920)}" for _ in range(12)]) for k in range(120)]
    rosters = stored(spark.createDataFrame(rosters, "league_id string, roster_id string, players array<string>"))
    return stored(players), rosters, spark.createDataFrame([(f"L{k}",) for k in range(40)], "league_id string")


@pytest.mark.parametrize("order", leagues.ORDERS)
def test_waiver_of_all_leagues_equals_each_ones(world, order):
    players, rosters, ids = world
    got = {}
    for r in leagues.waiver_all(players, rosters, ids, 5, order).orderBy("place").collect():
        got.setdefault(r["league_id"], []).append((r["player_id"], r["score"]))
    assert len(got) == 40
    for lid in ("L0", "L1", "L17", "L38", "L39"):
        want = gold.waiver_recommendations(players, rosters, lid, 5, order).collect()
        assert got[lid] == [(r["player_id"], r["score"]) for r in want], lid


def test_waiver_with_fewer_players_than_asked_for(spark, world):
    players, rosters, ids = world
    few = players.where("player_id in ('p1', 'p2', 'p3')")
    got = leagues.waiver_all(few, rosters, ids, 5).groupBy("league_id").count().collect()
    assert {r["count"] for r in got} <= {1, 2, 3}
    with pytest.raises(ValueError):
        leagues.waiver_all(players, rosters, ids, -1)
    with pytest.raises(ValueError):
        leagues.waiver_all(players, rosters, ids, 5, "name")


def test_available_of_all_leagues_and_expansion(world):
    players, rosters, ids = world
    place = leagues.ranked_players(players)
    bitmaps = stored(leagues.excluded_bitmaps(place, rosters))
    rows = {r["league_id"]: r for r in leagues.available_all(place, bitmaps, ids).collect()}
    assert len(rows) == 40 and rows["L39"]["n_available"] == 900 and rows["L39"]["n_excluded"] == 0
    for lid in ("L0", "L1", "L38", "L39"):
        want = sorted(r["player_id"] for r in gold.available_players(players, rosters, lid).collect())
        assert sorted(r["player_id"] for r in leagues.expand(place, bitmaps, lid).collect()) == want
        assert rows[lid]["n_available"] == len(want)
    assert rows["L0"]["digest"] != rows["L1"]["digest"]


def test_no_plan_multiplies_leagues_by_players(world):
    players, rosters, ids = world
    place = leagues.ranked_players(players)
    for df in (leagues.waiver_all(players, rosters, ids, 5), leagues.expand(place, leagues.excluded_bitmaps(place, rosters), "L1")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
