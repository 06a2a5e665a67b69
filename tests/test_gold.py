"""Gold answers: availability, injuries, validation, waiver."""

import pytest

from ingot.plans import gold
from ingot.plans import silver as sv

from conftest import bronze_records


@pytest.fixture()
def silver(spark):
    players = sv.players(bronze_records(spark, [
        {"player_id": f"p{i}", "display_name": f"Player {i}", "position": "WR", "team": "KC",
         "trending": (None if i == 3 else i / 10)}
        for i in range(30)
    ] + [{"player_id": "p5", "display_name": "Five again", "trending": 9.0}]))
    rosters = sv.rosters(bronze_records(spark, [
        {"league_id": "L1", "roster_id": 1, "players": ["p0", "p1"]},
        {"league_id": "L1", "roster_id": 2, "players": ["p2"]},
        {"league_id": "L2", "roster_id": 1, "players": ["p7"]},
        {"league_id": "L1", "roster_id": 2, "players": ["p2", "p4"]},
    ]))
    leagues = sv.leagues(bronze_records(spark, [{"league_id": "L1", "name": "My League"}]))
    return players, rosters, leagues


def test_available_players_excludes_rostered(silver):
    players, rosters, _ = silver
    got = {r.player_id for r in gold.available_players(players, rosters, "L1").collect()}
    assert got == {f"p{i}" for i in range(30)} - {"p0", "p1", "p2", "p4"}
    assert gold.available_players(players, rosters, None).count() == 30
    assert gold.available_players(players, rosters, "").count() == 30
    assert gold.available_players(players, rosters, "L404").count() == 30


def test_default_league_and_all_players(spark, silver):
    players, rosters, _ = silver
    spark.conf.set(gold.DEFAULT_LEAGUE_CONF, "L1")
    try:
        by_default = {r.player_id for r in gold.available_players(players, rosters).collect()}
        assert by_default == {r.player_id for r in gold.available_players(players, rosters, "L1").collect()}
        assert gold.available_players(players, rosters, gold.ALL_PLAYERS).count() == 30
        assert gold.available_players(players, rosters, "L404").count() == 30
    finally:
        spark.conf.unset(gold.DEFAULT_LEAGUE_CONF)


def test_player_object_shape(silver):
    players, rosters, _ = silver
    out = sv.public(gold.gold_available_players(players, rosters, "L1"))
    assert out.columns == ["id", "player_id", "name", "position", "team", "status", "age", "trending"]
    assert all(r.id == r.player_id for r in out.collect())


def test_waiver_arrival_order_limit_and_score(silver):
    players, rosters, _ = silver
    recs = gold.waiver_recommendations(players, rosters, "L1", limit=5).collect()
    assert [r.player_id for r in recs] == ["p3", "p5", "p6", "p7", "p8"]
    assert recs[0].score == 0.0  # NULL trending -> 0.0
    assert recs[1].name == "Five again" and recs[1].score == 9.0
    assert sv.public(gold.waiver_recommendations(players, rosters, "L1")).columns == [
        "player_id", "name", "position", "team", "score"]
    assert gold.waiver_recommendations(players, rosters, "L1").count() == 20
    assert gold.waiver_recommendations(players, rosters, "L1", limit=0).count() == 0
    best = gold.waiver_recommendations(players, rosters, "L1", limit=2, order="score").collect()
    assert [r.player_id for r in best] == ["p5", "p29"]
    with pytest.raises(ValueError):
        gold.waiver_recommendations(players, rosters, "L1", limit=-1)


def test_validation_and_missing(spark, silver):
    _, rosters, leagues = silver
    got = {r.league_id: (r.valid, r.league_name) for r in gold.validate_leagues(spark, leagues, ["L1", "bad"]).collect()}
    assert got == {"L1": (True, "My League"), "bad": (False, "")}
    missing = gold.leagues_missing(spark, rosters.select("league_id"), ["L1", "L2", "L3"])
    assert [r.league_id for r in missing.collect()] == ["L3"]


def test_injury_report_ignores_league(spark):
    players = sv.players(bronze_records(spark, [
        {"player_id": "p1", "injury_status": "Out", "updated_at": "2024-01-01"},
        {"player_id": "p2", "injury_status": "Q"},
    ]))
    rep = gold.injury_report(players, "any-league")
    assert rep.count() == 2
    lines = sorted(r.value for r in gold.to_json_lines(rep).collect())
    assert lines == ['{"player_id":"p1","status":"Out","updated_at":"2024-01-01"}', '{"player_id":"p2","status":"Q"}']


def test_roster_partitions_follow_the_input(spark, monkeypatch):
    """as many partitions as the input asks for, with the same rosters."""
    from conftest import SF001

    from ingot.plans import roles

    rows = lambda: sorted((r.league_id, r.roster_id, sorted(r.players)) for r in roles.silver_rosters(spark, SF001).collect())
    before = rows()
    monkeypatch.setattr(roles, "PART_BYTES", 10_000)
    plan = roles.roster_records(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    counts = {int(line.split()[-1]) for line in plan.splitlines() if "RepartitionByExpression" in line for line in [line.split("[")[-1].split("]")[-1].strip(" ,")]}
    assert counts and min(counts) > spark.sparkContext.defaultParallelism
    assert rows() == before
