"""Landed payloads, key injection, generic and registered sources (S1-S8), on rows of the given tables."""

import json

import pytest

from ingot.sources import bronze, files, ingest, landed
from ingot.sources.datasources import JsonLineFiles

from conftest import SF001


def land(base, rel, value):
    p = base / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def rows_of(df):
    return [(r.is_malformed, r.record if r.is_malformed else json.loads(r.record)) for r in df.orderBy("_file", "_block", "_pos").collect()]


@pytest.fixture(scope="module")
def parts(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF001}/part.parquet").select("p_partkey", "p_name", "p_brand").limit(6).collect()]


def test_snapshot_entries_get_their_key(spark, tmp_path, parts):
    doc = {str(p["p_partkey"]): {"label": p["p_name"], "brand": p["p_brand"]} for p in parts}
    doc |= {"scalar": 3.5, "own": {"player_id": None, "label": "x"}}
    land(tmp_path, "players/a.json", doc)
    land(tmp_path, "players/b.json", [{"label": "listed"}, 8])
    land(tmp_path, "players/c.json", "false")
    land(tmp_path, "players/d.json", json.dumps(doc)[:-9])
    got = rows_of(landed.players_snapshot(spark, str(tmp_path)))
    want = [(False, {"player_id": k, **v}) for k, v in doc.items() if isinstance(v, dict)]
    want += [(False, {"player_id": "scalar", "raw": 3.5}), (False, {"label": "listed"}), (False, 8), (True, json.dumps(doc)[:-9])]
    plain = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert plain(got) == plain(want)


def test_snapshot_lines_keep_their_order(spark, tmp_path, parts):
    lines = [json.dumps({str(p["p_partkey"]): {"label": p["p_name"]}}) for p in parts]
    land(tmp_path, "players/all.jsonl", "\n".join([*lines[:3], "{cut", "", *lines[3:]]) + "\n")
    got = rows_of(landed.players_snapshot(spark, str(tmp_path), pattern="players/*.jsonl", whole=False))
    want = [(False, {"player_id": str(p["p_partkey"]), "label": p["p_name"]}) for p in parts]
    assert got == [*want[:3], (True, "{cut"), *want[3:]]


def test_league_payloads_keep_what_is_damaged(spark, tmp_path):
    for name, value in {"ok": {"title": "A"}, "own": {"league_id": None}, "none": "null", "list": [1], "cut": '{"title": "B"'}.items():
        land(tmp_path, f"league/{name}.json", value)
    ids = ["ok", "own", "none", "list", "cut", "absent", "o*"]
    got = rows_of(landed.league_records(spark, str(tmp_path), ids))
    assert sorted(map(str, got)) == sorted(map(str, [
        (False, {"league_id": "ok", "title": "A"}), (False, {"league_id": None}), (True, "[1]"), (True, '{"title": "B"')]))
    assert landed.league_records(spark, str(tmp_path), ["o*"]).count() == 0
    asked = spark.createDataFrame([("ok",), ("ok",), ("absent",)], "id string")
    assert rows_of(landed.league_records(spark, str(tmp_path), asked)) == [(False, {"league_id": "ok", "title": "A"})]


def test_lists_keep_damaged_elements(spark, tmp_path):
    land(tmp_path, "rosters/5.json", [{"roster_id": 1}, "stray", {"roster_id": 2, "league_id": "mine"}, None])
    land(tmp_path, "rosters/6.json", '[{"roster_id": 3}')
    land(tmp_path, "rosters/7.json", {"roster_id": 4})
    got = rows_of(landed.roster_records(spark, str(tmp_path), ["5", "6", "7", "8"]))
    assert got == [(False, {"league_id": "5", "roster_id": 1}), (True, '"stray"'), (False, {"league_id": "mine", "roster_id": 2}),
                   (True, "null"), (True, '[{"roster_id": 3}')]
    land(tmp_path, "matchups/5/2.json", [{"points": 1.5}])
    land(tmp_path, "matchups/5/3.json", [{"points": 9}])
    assert rows_of(landed.matchup_records(spark, str(tmp_path), ["5"], 2)) == [(False, {"league_id": "5", "week": 2, "points": 1.5})]
    assert landed.matchup_records(spark, str(tmp_path), ["5"], 4).count() == 0


def test_ingest_of_leagues_as_files_and_lines(spark, tmp_path):
    base, root = tmp_path / "landing", str(tmp_path / "store")
    land(base, "league/1.json", {"title": "file"})
    payload = json.dumps([{"roster_id": 1}, 5])
    land(base, "rosters/all.jsonl", "\n".join(json.dumps({"league_id": i, "payload": p}) for i, p in (("1", payload), ("2", payload), ("1", "[{"))))
    landed.ingest(spark, str(base), root, ["1"])
    rows = bronze.scan(spark, root)
    counts = {r.tbl: (r.row_count, r.malformed_count) for r in bronze.quarantine_counts(rows).collect()}
    assert counts == {"league": (1, 0), "rosters": (3, 2)}
    listed = {(r.name, r.row_count) for r in bronze.catalog_at(spark, root).collect()}
    assert listed == {("league", 1), ("rosters", 3), ("matchups", 0)}
    assert {r.record for r in bronze.quarantine(rows).collect()} == {"5", "[{"}


@pytest.mark.parametrize("as_table", [False, True])
def test_damaged_outer_lines_are_kept_whole(spark, tmp_path, as_table):
    line = lambda i, week, payload: json.dumps({"league_id": i, "week": week, "payload": json.dumps(payload)})
    lost = [line("1", 1, [{"n": 3}])[:k] for k in (8, 20, 35, -3, -1)] + ["not JSON", "17", '["1"]', '{"week": 1, "payload": "[]"}',
            '{"league_id": null, "week": 1, "payload": "[]"}', '{"league_id": "1", "week": 1}', '{"league_id": "1", "week": 1, "payload": null}',
            line("1", 1, []) * 2, line("1", 1, []) + "x"]
    for kind, payload in (("league", {"n": 1}), ("rosters", [{"n": 1}]), ("matchups", [{"n": 1}])):
        good = [line("1", 1, payload), line("2", 1, payload), line("1", 2, payload)]
        land(tmp_path, f"{kind}/0.jsonl", "\n".join([*good, *lost, '{"league_id": "1", "week": "x", "payload": "[]"}', '{"league_id": "2"}']))
    ids = spark.createDataFrame([("1",)], "id string") if as_table else ["1"]
    ends = {"league": ["[]"], "rosters": [], "matchups": ['{"league_id": "1", "week": "x", "payload": "[]"}']}
    reads = {"league": landed.league_records, "rosters": landed.roster_records, "matchups": landed.matchup_records}
    for kind, read in reads.items():
        got = rows_of(read(spark, str(tmp_path), ids, lines=True))
        assert sorted(r for bad, r in got if bad) == sorted([*lost, *ends[kind]]), kind
        assert sum(not bad for bad, _ in got) == (1 if kind == "matchups" else 2)


def test_a_wrong_path_is_an_error_and_an_empty_one_is_not(spark, tmp_path):
    assert landed.players_snapshot(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nosuch"):
        files.matches(spark, "nosuch://place/x")


def test_any_format_goes_to_bronze(spark, tmp_path):
    nation = spark.read.parquet(f"{SF001}/nation.parquet")
    nation.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    rows = ingest.ingest_format(spark, "csv", "files", "nations", path=str(tmp_path / "csv"), header=True)
    assert sorted(json.loads(r.record)["n_name"] for r in rows.collect()) == sorted(r.n_name for r in nation.collect())
    assert all(r._file.endswith(".csv") for r in rows.select("_file").collect())
    assert ingest.ingest_dataframe(nation, "frame").select("source_id", "tbl").first() == ("frame", "events")


def test_a_registered_python_source_reads_files_on_executors(spark, tmp_path, parts):
    for k in range(3):
        land(tmp_path, f"in/{k}.jsonl", "\n".join(json.dumps(p) for p in parts[k::3]) + "\n")
    name = ingest.register_datasource(spark, JsonLineFiles)
    df = ingest.get_source(name)(spark, path=str(tmp_path / "in"))
    assert df.rdd.getNumPartitions() == 3 and name in ingest.registered_sources()
    rows = bronze.records_from_json_column(df, "record", name, "parts")
    assert sorted(json.loads(r.record)["p_partkey"] for r in rows.collect()) == sorted(p["p_partkey"] for p in parts)
    with pytest.raises(KeyError):
        ingest.get_source("nope")
