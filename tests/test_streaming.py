"""Streaming bronze ingest and incremental silver."""

import json

import duckdb

import __spark_entry__ as E
from ingot.functions.expr import json_fields
from ingot.plans import silver as sv
from ingot.session import scratch_path
from ingot.sources import bronze, commits, files
from ingot.streaming import bronze_stream as bs

from conftest import SF001


def _write(path, recs):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in recs) + "\n", encoding="utf-8")


def test_stream_to_bronze_then_incremental_silver(spark, tmp_path):
    land, root, silver = tmp_path / "land", str(tmp_path / "store"), str(tmp_path / "silver_players")
    ck1, ck2 = str(tmp_path / "ck1"), str(tmp_path / "ck2")
    _write(land / "a.jsonl", [{"player_id": "p1", "display_name": "Old"}, {"player_id": "p2", "display_name": "Two"}])
    q = bs.stream_to_bronze(spark, str(land), root, "league_api", "players", checkpoint=ck1)
    q.awaitTermination(120)
    assert bronze.scan(spark, root, "league_api", "players").count() == 2
    q = bs.incremental_silver(spark, root, silver, checkpoint=ck2)
    q.awaitTermination(120)
    cur = bs.read_current(spark, silver)
    assert {r.player_id: r.name for r in cur.collect()} == {"p1": "Old", "p2": "Two"}

    # second file: an update for p1 and a new player; only the new file is read
    _write(land / "b.jsonl", [{"player_id": "p1", "display_name": "New"}, {"player_id": "p3", "display_name": "Three"}])
    bs.stream_to_bronze(spark, str(land), root, "league_api", "players", checkpoint=ck1).awaitTermination(120)
    assert bronze.scan(spark, root, "league_api", "players").count() == 4
    bs.incremental_silver(spark, root, silver, checkpoint=ck2).awaitTermination(120)
    cur = bs.read_current(spark, silver)
    got = {r.player_id: r.name for r in cur.collect()}
    assert got == {"p1": "New", "p2": "Two", "p3": "Three"}
    # the incremental result equals a full rebuild, first-seen order included
    full = sv.players(bronze.parsed(bronze.scan(spark, root, "league_api", "players")), json_fields())
    assert [r.player_id for r in full.orderBy("_first_seq").collect()] == [
        r.player_id for r in cur.orderBy("_first_seq").collect()] == ["p1", "p2", "p3"]


def test_restart_with_defaults_and_replay_change_nothing(spark, tmp_path):
    land, root, silver = tmp_path / "land", str(tmp_path / "store"), str(tmp_path / "silver")
    _write(land / "a.jsonl", [{"player_id": f"q{i}", "display_name": str(i)} for i in range(40)])
    for _ in range(2):  # the second start finds nothing new
        bs.stream_to_bronze(spark, str(land), root, "league_api", "players").awaitTermination(120)
        bs.incremental_silver(spark, root, silver).awaitTermination(120)
    rows = bronze.scan(spark, root, "league_api", "players")
    assert rows.count() == 40
    before = bs.read_current(spark, silver)
    held = sorted(map(str, before.collect()))
    # a replayed micro-batch: the same rows are merged again
    after = bs.merge_players(spark, silver, bronze.parsed(rows))
    assert sorted(map(str, after.collect())) == held
    # an unfinished switch leaves the last version; what was read before stays readable
    (tmp_path / "silver" / "_versions" / "999999999999").write_text("")
    assert sorted(map(str, bs.read_current(spark, silver).collect())) == sorted(map(str, before.collect())) == held


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    silver = str(tmp_path / "silver")
    make = lambda ids: bronze.parsed(bronze.records_from_json_column(
        spark.createDataFrame([(json.dumps({"player_id": i}),) for i in ids], "j string"), "j", "s", "players"))
    bs.merge_players(spark, silver, make([f"q{i}" for i in range(200)]))
    first = bs._manifest(spark, silver)
    assert bs.merge_players(spark, silver, make(["q7"])).count() == 200
    second = bs._manifest(spark, silver)
    assert sum(first[b] != second[b] for b in second) == 1


def test_counts_follow_replaced_records(spark, tmp_path):
    def records(batch, recs):
        rows = spark.createDataFrame([(json.dumps(x),) for x in recs], "j string")
        return bronze.parsed(bronze.records_from_json_column(rows, "j", "s", "t", batch_id=batch))

    path = str(tmp_path / "players")
    assert bs.counts(spark, path) == {"players": 0, "injuries": 0}
    hurt, well = {"injury_status": "Out"}, {"status": "Active"}
    steps = [
        (2, [{"player_id": f"p{i}", **(hurt if i < 5 else well)} for i in range(20)], (20, 5)),
        (3, [{"player_id": "p1", **well}, {"player_id": "p9", **hurt}, {"player_id": "p10", **hurt}, {"name": "no id"}], (20, 6)),
        (1, [{"player_id": "p0", **well}, {"player_id": "old", **hurt}], (21, 7)),  # came late: p0 stays as it is
        (3, [{"player_id": "p1", **well}, {"player_id": "p9", **hurt}, {"player_id": "p10", **hurt}], (21, 7)),  # a replay
        (4, [{"player_id": "p1", **hurt}, {"player_id": "p1", **well}], (21, 7)),
        (5, [{"player_id": f"p{i}", **well} for i in range(20)], (21, 1)),  # more than MAX_RUNS: merged
        (6, [{"name": "no id"}], (21, 1)),
    ]
    for batch, recs, (players, injuries) in steps:
        bs.merge(spark, path, records(batch, recs))
        assert bs.counts(spark, path) == bs.recount(spark, path) == {"players": players, "injuries": injuries}
    for tbl, recs, n in [
        ("league", [{"league_id": "1", "name": "a"}, {"league_id": "1", "name": "b"}, {"league_id": 0}], 1),
        ("rosters", [{"league_id": "1", "roster_id": 1, "players": ["x"]}, {"league_id": "1", "roster_id": 2}, {"league_id": "1"}], 2),
    ]:
        for batch in (1, 2):
            bs.merge(spark, str(tmp_path / tbl), records(batch, recs), tbl)
        assert bs.counts(spark, str(tmp_path / tbl), tbl) == {tbl: n}


def test_counts_of_a_manifest_without_them(spark, tmp_path):
    path = str(tmp_path / "silver")
    rows = bronze.parsed(bronze.records_from_json_column(spark.createDataFrame([('{"player_id": "a"}',)], "j string"), "j", "s", "t"))
    bs.merge(spark, path, rows)
    lines = [x for x in files.current(spark, f"{path}/_versions") if not x.startswith("counts")]
    files.publish(spark, f"{path}/_versions", "\n".join(lines))
    assert bs.counts(spark, path) == {"players": 1, "injuries": 0}


def test_streamed_records_are_parsed_once(spark, tmp_path):
    """A micro-batch keeps its parsed records, and silver reads their fields as columns; text folders and log entries of before are read too."""
    land, root, silver = tmp_path / "land", str(tmp_path / "store"), str(tmp_path / "silver")
    _write(land / "a.jsonl", [{"player_id": f"q{i}", "display_name": f"N{i}", "age": str(i)} for i in range(40)])
    (land / "b.jsonl").write_text('{"player_id": "q1"\n\n{"player_id": "q2", "display_name": "Two"}\n', encoding="utf-8")
    bs.stream_to_bronze(spark, str(land), root, "league_api", "players").awaitTermination(120)
    text = spark.createDataFrame([(json.dumps({"player_id": "q3", "display_name": "Three"}),), ("{bad",)], "j string")
    bronze.append(bronze.records_from_json_column(text, "j", "league_api", "players"), root)
    assert sorted(f.variant for f in commits.snapshot(spark, root).of()) == [False, True]
    assert bronze.scan(spark, root).where("is_malformed").count() == 2
    adds = [{"path": f.path, **({"variant": True} if f.variant else {})} for f in commits.snapshot(spark, root).of()]
    rows = bronze.parsed_commits(spark, root, adds, "league_api", "players")
    assert rows.count() == 42
    assert bronze.parsed_commits(spark, root, [*adds, {"path": "commit=gone/source_id=s/tbl=t"}], "league_api", "players") is None
    streamed = bronze.parsed_commits(spark, root, [a for a in adds if "variant" in a], "league_api", "players")
    plan = sv.players(streamed)._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" not in plan
    bs.incremental_silver(spark, root, silver).awaitTermination(120)
    got = {r.player_id: (r.name, r.age) for r in bs.read_current(spark, silver).collect()}
    assert got == {f"q{i}": (f"N{i}", i) for i in range(40)} | {"q2": ("Two", None), "q3": ("Three", None)}


def test_stream_silver_lands_compressed_lines_and_keeps_every_row(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(E, "scratch_path", lambda s, n: seen.setdefault(n, scratch_path(s, n)))
    df = E.queries()["stream_silver"](spark, SF001)
    lines = spark.read.text(seen["landing"])
    length = lines.selectExpr("sum(length(value) + 1) n").first().n
    assert files.size(spark, seen["landing"])[0] < length / 4
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{SF001}/lineitem.parquet')")
    assert lines.count() == bronze.scan(spark, seen["store"]).count() == con.execute("select count(*) from lineitem").fetchone()[0]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(E.oracle_sql()["stream_silver"]).fetchall()))
