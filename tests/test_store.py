"""The store's commit log: concurrent writers, replays, snapshots, compaction, vacuum, key files, counts, streams."""

import json
import threading
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as E
from ingot.functions.expr import json_fields
from ingot.plans import catalog as cat
from ingot.plans import gold, pipeline, roles
from ingot.plans import silver as sv
from ingot.session import at_least_partitions
from ingot.sources import bronze, commits, files
from ingot.streaming import bronze_stream as bs

from conftest import SF001


def rows_of(spark, values, tbl="t", source_id="s"):
    lines = spark.createDataFrame([(json.dumps(v) if not isinstance(v, str) else v,) for v in values], "j string")
    return bronze.records_from_json_column(lines, "j", source_id, tbl)


def held(spark, root, **of):
    return sorted(r["record"] for r in bronze.scan(spark, root, **of).collect())


@pytest.fixture()
def root(tmp_path):
    return str(tmp_path / "store")


def test_a_store_without_appends_is_empty(spark, root):
    assert bronze.scan(spark, root).count() == 0
    assert bronze.keys(spark, root, "s", "t").count() == 0
    assert bronze.compact(spark, root) == 0


def test_eight_writers_at_once_keep_all_rows(spark, root):
    def write(i):
        return bronze.append(rows_of(spark, [{"w": i, "n": n} for n in range(5)]), root)

    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(write, range(8)))
    assert len(held(spark, root)) == 40
    assert sorted(numbers) == list(range(1, 9))
    seq = [tuple(r) for r in bronze.scan(spark, root).select("_batch_id", "_writer", "_file", "_block", "_pos").collect()]
    assert len(set(seq)) == 40


def test_appends_under_one_number_keep_all_rows(spark, root, monkeypatch):
    """A file system that lets two writers create one file: the numbers are equal, the rows are not lost."""
    monkeypatch.setattr(bronze, "allocate_batch", lambda *a: 7)
    for i in range(3):
        bronze.append(rows_of(spark, [{"w": i}]), root)
    rows = bronze.scan(spark, root).collect()
    assert len(rows) == 3 and {r["_batch_id"] for r in rows} == {7} and len({r["_writer"] for r in rows}) == 3


def test_publishers_do_not_replace_each_other(spark, tmp_path):
    place = str(tmp_path / "v")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: files.publish(spark, place, f"line {i}"), range(8)))
    texts = {files.read(spark, f"{place}/{n}").strip() for n in files.names(spark, place)}
    assert texts == {f"line {i}" for i in range(8)} and files.current(spark, place)[0] in texts


def test_only_one_creates_a_file(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: files.create(spark, str(tmp_path / "d" / "one file %41")), range(8)))
    assert sorted(got) == [False] * 7 + [True]


def test_two_attempts_of_one_key_count_once(spark, root):
    first = commits.snapshot(spark, root)
    for n in (1, 2):  # both attempts saw an empty log
        folders = bronze._write(rows_of(spark, [{"n": 1}]), root, {})
        commits.commit(spark, root, "append", first, folders, number=1, key="k")
    assert len(held(spark, root)) == 1
    assert bronze.append(rows_of(spark, [{"n": 9}]), root, key="k") == 1  # known: nothing is written
    assert len(held(spark, root)) == 1
    commits.summarise(spark, root)
    assert len(held(spark, root)) == 1


def test_many_appends_then_compaction(spark, root):
    for i in range(40):
        bronze.append(rows_of(spark, [{"n": i}, {"n": -i}]), root)
    bronze.append(rows_of(spark, [{"m": 1}], tbl="u"), root)
    before, old = held(spark, root), bronze.scan(spark, root, "s", "t")
    names = files.names(spark, f"{root}/{commits.LOG_DIR}")
    assert any(n.endswith(commits.SUMMARY) for n in names)  # reading doesn't follow the history
    assert bronze.compact(spark, root) == 40
    assert held(spark, root) == before and len(before) == 81
    live = commits.snapshot(spark, root).of("s", "t")
    assert len(live) == 1 and live[0].rows == 80 and live[0].files <= 2
    assert bronze.compact(spark, root) == 0
    assert old.count() == 80  # a reader of the old snapshot is unharmed
    # arrival order survives
    order = [json.loads(r["record"])["n"] for r in bronze.first_rows(bronze.scan(spark, root, "s", "t")).collect()]
    assert order == [x for i in range(40) for x in (i, -i)]
    # earlier states, and what vacuum leaves
    assert bronze.scan(spark, root, "s", "t", as_of=10).count() == 20
    assert bronze.vacuum(spark, root) == 0  # nothing is old enough
    assert bronze.vacuum(spark, root, older_than=-60) >= 40 + 32
    assert held(spark, root) == before and bronze.scan(spark, root, "s", "t", as_of=10).count() == 20
    bronze.append(rows_of(spark, [{"n": 99}]), root)
    assert len(held(spark, root)) == 82 and len(files.names(spark, f"{root}/bronze")) == 3


def test_an_append_during_a_compaction_stays(spark, root, monkeypatch):
    for i in range(3):
        bronze.append(rows_of(spark, [{"n": i}]), root)
    write = bronze._write

    def late(*args):
        out = write(*args)
        monkeypatch.setattr(bronze, "_write", write)
        bronze.append(rows_of(spark, [{"n": 50}]), root)  # between the rewrite and its commit
        bronze.compact(spark, root)  # and another compaction of the same folders
        return out

    monkeypatch.setattr(bronze, "_write", late)
    bronze.compact(spark, root)
    assert [json.loads(r)["n"] for r in held(spark, root)] == [0, 1, 2, 50]


def test_folders_of_failed_writes_are_no_rows(spark, root):
    bronze.append(rows_of(spark, [{"n": 1}]), root)
    bronze._write(rows_of(spark, [{"n": 2}]), root, {})  # written, never committed
    assert len(held(spark, root)) == 1
    bronze.vacuum(spark, root, older_than=-60)
    assert len(files.names(spark, f"{root}/bronze")) == 1 and len(held(spark, root)) == 1


def test_counts_from_the_log_equal_a_recount(spark, root):
    bronze.append(rows_of(spark, [{"a": 1}, "{bad", {"a": 2}]), root, [("s", "t"), ("s", "empty")], key="x")
    bronze.append(rows_of(spark, [{"a": 1}, "{bad", {"a": 2}]), root, key="x")  # an overlapping batch
    bronze.append(rows_of(spark, [{"a": 3}, "worse"], tbl="u/v w"), root)
    bronze.append(rows_of(spark, [{"a": 4}]), root)
    recount = lambda: sorted(map(tuple, bronze.catalog(bronze.scan(spark, root), bronze.listing(spark, root)).collect()))
    damaged = lambda df: sorted(map(tuple, df.collect()))
    for _ in range(2):
        assert sorted(map(tuple, bronze.catalog_at(spark, root).collect())) == recount()
        assert damaged(bronze.quarantine_at(spark, root)) == damaged(bronze.quarantine_counts(bronze.scan(spark, root)))
        bronze.compact(spark, root)
    assert ("bronze", "s", "u/v w", 2) in recount() and ("bronze", "s", "t", 4) in recount()


def test_keys_read_no_record(spark, root):
    index = {"rosters": "league_id"}
    for ids in (["L1", "L2"], ["L2", "L3"], [7]):
        bronze.append(rows_of(spark, [{"league_id": i, "roster_id": 1} for i in ids] + ["{bad", {"x": 1}], "rosters", "league_api"), root, index=index)
    keys = lambda: bronze.keys(spark, root, "league_api", "rosters")
    assert sorted(r["key"] for r in keys().collect()) == ["7", "L1", "L2", "L3"]
    missing = gold.leagues_missing(spark, pipeline.ingested_league_ids(spark, root), ["L1", "L9"])
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert "record#" not in plan and "parse_json" not in plan and "key:string" in plan
    assert [r["league_id"] for r in missing.collect()] == ["L9"]
    bronze.compact(spark, root)
    assert sorted(r["key"] for r in keys().collect()) == ["7", "L1", "L2", "L3"]
    assert commits.snapshot(spark, root).of("league_api", "rosters")[0].index
    # without an index the records are read
    bronze.append(rows_of(spark, [{"league_id": "L5"}], "rosters", "league_api"), root)
    assert sorted(r["key"] for r in keys().collect()) == ["7", "L1", "L2", "L3", "L5"]


# --------------------------------------------------------------------------- streams
def land(folder, name, ids, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"player_id": i, "display_name": text}) for i in ids) + "\n", encoding="utf-8")


def replay(spark, checkpoint):
    done = f"{checkpoint}/commits"
    files.remove(spark, f"{done}/{max((n for n in files.names(spark, done) if n.isdigit()), key=int)}")


def test_a_replay_between_two_steps_of_silver(spark, tmp_path, root):
    silver, ck = str(tmp_path / "silver"), str(tmp_path / "ck")

    def step():
        bs.stream_to_bronze(spark, str(tmp_path / "land"), root, "league_api", "players", checkpoint=f"{ck}/b").awaitTermination(120)
        bs.incremental_silver(spark, root, silver, checkpoint=f"{ck}/s").awaitTermination(120)

    land(tmp_path / "land", "a.jsonl", ["p1", "p2"], "one")
    step()
    replay(spark, f"{ck}/b")
    bs.stream_to_bronze(spark, str(tmp_path / "land"), root, "league_api", "players", checkpoint=f"{ck}/b").awaitTermination(120)
    bronze.append(rows_of(spark, [{"player_id": "p9", "display_name": "batch"}], "players", "league_api"), root)
    bronze.append(rows_of(spark, [{"player_id": "zz"}], "other", "league_api"), root)
    land(tmp_path / "land", "b.jsonl", ["p1", "p3"], "two")
    replay(spark, f"{ck}/s")
    step()
    bronze.compact(spark, root)  # adds no rows
    step()
    assert bronze.scan(spark, root, "league_api", "players").count() == 5
    got = {r["player_id"]: (r["name"], r["_first_seq"]["_batch_id"]) for r in bs.read_current(spark, silver).collect()}
    full = sv.players(bronze.parsed(bronze.scan(spark, root, "league_api", "players")), json_fields())
    assert got == {r["player_id"]: (r["name"], r["_first_seq"]["_batch_id"]) for r in full.collect()}
    assert {i: n for i, (n, _) in got.items()} == {"p1": "two", "p2": "one", "p3": "two", "p9": "batch"}


def test_silver_catches_up_after_vacuum(spark, tmp_path, root):
    silver = str(tmp_path / "silver")
    for i in range(3):
        bronze.append(rows_of(spark, [{"player_id": f"p{i}"}], "players", "league_api"), root)
    bronze.compact(spark, root)
    bronze_folders = len(files.names(spark, f"{root}/bronze"))
    for f in files.names(spark, f"{root}/bronze"):  # the folders that the entries name are gone, the entries are still there
        if f not in {x.path.split("/")[0] for x in commits.snapshot(spark, root).of()}:
            files.remove(spark, f"{root}/bronze/{f}")
    assert len(files.names(spark, f"{root}/bronze")) == 1 < bronze_folders
    bs.incremental_silver(spark, root, silver).awaitTermination(120)
    assert sorted(r["player_id"] for r in bs.read_current(spark, silver).collect()) == ["p0", "p1", "p2"]


def test_what_is_written_follows_the_batch(spark, tmp_path):
    silver = str(tmp_path / "silver")
    make = lambda ids, n=0: bronze.parsed(rows_of(spark, [{"player_id": i, "display_name": f"v{n}"} for i in ids]))
    bs.merge_players(spark, silver, make([f"q{i}" for i in range(3000)]))
    whole = files.size(spark, silver)[0]
    for n in range(1, 3):
        bs.merge_players(spark, silver, make(["q1", "q2", "q3"], n))
    assert files.size(spark, silver)[0] < whole * 1.5
    for n in range(3, 8):
        bs.merge_players(spark, silver, make(["q1"], n))
    runs = bs._manifest(spark, silver)
    assert max(len(r) for r in runs.values()) <= bs.MAX_RUNS
    cur = bs.read_current(spark, silver)
    assert cur.count() == 3000
    assert bs.vacuum_silver(spark, silver, older_than=-60) > 0
    assert bs.read_current(spark, silver).count() == 3000


def test_silver_reads_only_the_fields_it_needs(spark, root):
    big = "x" * 500
    people = [{"player_id": f"p{i}", "display_name": f"N{i}", "bio": big, "age": 20 + i, "number": i} for i in range(50)]
    bronze.append(rows_of(spark, [*people, "{bad"], "players"), root, variant=True)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        df = sv.players(bronze.parsed_at(spark, root, "s", "players"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line).partition("ReadSchema")[2]
    assert "record_v:struct<" in scan and "player_id" in scan  # fields, as columns of their own
    assert "bio" not in scan and "record:string" not in scan
    assert {r["player_id"]: (r["name"], r["age"]) for r in df.collect()} == {p["player_id"]: (p["display_name"], p["age"]) for p in people}
    # folders without parsed records are parsed, and compaction keeps what there is
    bronze.append(rows_of(spark, [{"player_id": "p1", "display_name": "later"}, {"player_id": "q"}], "players"), root)
    for _ in range(2):
        got = {r["player_id"]: r["name"] for r in sv.players(bronze.parsed_at(spark, root, "s", "players")).collect()}
        assert len(got) == 51 and got["p1"] == "later" and got["p2"] == "N2"
        bronze.compact(spark, root)
    assert [f.variant for f in commits.snapshot(spark, root).of()] == [True]


def test_a_record_is_parsed_once_on_its_way_in(spark, root):
    """The column that says whether a record is malformed and the parsed record come of one parse; keys come of the parsed column."""
    lines = spark.createDataFrame([(json.dumps({"league_id": i, "n": i}),) for i in range(5)] + [("{bad",), (None,)], "j string")
    rows = bronze.records_from_json_column(lines, "j", "s", "rosters", variant=True)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    bronze.append(rows, root, index={"rosters": "league_id"}, variant=True)
    plain = bronze.records_from_json_column(lines, "j", "s", "rosters")
    bronze.append(plain, root + "2", index={"rosters": "league_id"}, variant=True)
    for at in (root, root + "2"):
        assert sorted((r.record or "", r.is_malformed) for r in bronze.scan(spark, at).collect()) == sorted(
            [(json.dumps({"league_id": i, "n": i}), False) for i in range(5)] + [("{bad", True), ("", True)])
        assert sorted(r.key for r in bronze.keys(spark, at, "s", "rosters").collect()) == [str(i) for i in range(5)]
        assert bronze.parsed_at(spark, at, "s", "rosters").count() == 5
    bronze.append(rows, root + "3")  # without the parsed column it isn't written
    assert bronze.scan(spark, root + "3").count() == 7


def test_compaction_sorts_a_bounded_number_of_rows_in_a_task(spark, root, monkeypatch):
    monkeypatch.setattr(bronze, "TASK_ROWS", 10)
    for i in range(4):
        bronze.append(rows_of(spark, [{"i": i, "n": n} for n in range(20)]), root)
    before = held(spark, root)
    bronze.compact(spark, root)
    assert held(spark, root) == before
    folder = commits.snapshot(spark, root).of()
    assert len(folder) == 1 and folder[0].rows == 80 and folder[0].files >= 6


# --------------------------------------------------------------------------- catalog and samples over the store
def _fields_read(df, among):
    """Those of some fields that the plan of ``df`` names."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {f for f in among if f in plan}


def test_players_of_chosen_columns(spark, root):
    """No field is read that only other columns need, and the chosen columns' rows stay the same."""
    people = [
        {"player_id": f"p{i % 7}", "display_name": f"N{i}", "team": f"T{i}", "age": str(i), "trending": i / 2,
         "status": ["Active", "Inactive", ""][i % 3], "injury_status": ["Out", "", None, "Active"][i % 4], "updated_at": f"d{i}"}
        for i in range(50)
    ]
    bronze.append(rows_of(spark, [*people, {"id": 9, "status": "Out"}, {"player_id": 0}], "players"), root, variant=True)
    recs = bronze.parsed_at(spark, root, "s", "players")
    full, some = sv.players(recs), sv.players(recs, columns=sv.INJURY_COLUMNS)
    assert some.columns == [*sv.INJURY_COLUMNS, "_seq", "_first_seq"]
    assert _fields_read(some, ["injury_status", "display_name", "trending", "updated_at", "team"]) == {"injury_status"}
    assert sorted(some.collect()) == sorted(full.select(*some.columns).collect()) and some.count() == 8
    # what is made of them lacks just the columns that they were built without
    data = cat.silver_gold_datasets(some, sv.leagues(recs), sv.rosters(recs))
    whole = cat.silver_gold_datasets(full, sv.leagues(recs), sv.rosters(recs))
    for name in (("silver", "injuries"), ("gold", "injury"), ("gold", "available_players")):
        columns = data[name].columns
        assert set(columns) == set(whole[name].columns) - {"name", "position", "team", "age", "trending", "updated_at"}
        assert sorted(data[name].collect()) == sorted(whole[name].select(*columns).collect())


def test_partitions_follow_the_input(spark, monkeypatch):
    """The line items of 600 KB make many parts of some bytes each, in the order of their sequence."""
    monkeypatch.setattr(roles, "PART_BYTES", 8 << 10)
    parts = roles.partitions(spark, SF001)
    recs = roles.player_records(spark, SF001, ordered=True)
    assert parts > 10 and recs.rdd.getNumPartitions() == parts
    seqs = [tuple(r._seq) for r in recs.select("_seq").collect()]
    assert seqs == sorted(seqs) and len(seqs) == roles.player_records(spark, SF001).count()
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        for asked in (parts, 3):  # a smaller input takes nothing back
            at_least_partitions(spark, asked)
            assert int(spark.conf.get(name)) == max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    finally:
        spark.conf.unset(name)


def test_samples_aggregate_the_players_once(spark):
    """The four datasets of players in sample_named are read from one stored aggregate; the store's player records aren't read again."""
    df = E.queries()["sample_named"](spark, SF001)
    read = [str(f) for f in df.inputFiles()]
    assert read and not any("tbl=players" in f for f in read) and any("tbl=rosters" in f for f in read)
    _equals_oracle(spark, "sample_named", df)


def _equals_oracle(spark, name, df):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(E.oracle_sql()[name]).fetchall()))


def test_the_catalog_reads_only_what_decides(spark):
    df = E.queries()["catalog_full"](spark, SF001)
    assert _fields_read(df, ["injury_status", "display_name", "trending", "updated_at", "team"]) == {"injury_status"}
    _equals_oracle(spark, "catalog_full", df)


def test_only_strings_are_true_where_texts_are_ambiguous(spark, root):
    """Of stored and of parsed records the same ids count, and silver players read no field but the age as a VARIANT of its own."""
    values = [0, "0", 0.0, "0.0", -0.0, "-0", "00", False, "false", True, "true", [], "[]", {}, "{}", [0], None, "", " ", "x", 7, "0x", 1e-400]
    for n, ids in enumerate((values, [v for v in values if isinstance(v, str)], [0, 3, 0], [False, True])):  # of one type: columns of their own
        at, people = f"{root}{n}", [{"player_id": v, "id": f"id{i}", "status": v, "age": 5} for i, v in enumerate(ids)]
        bronze.append(rows_of(spark, people, "players"), at, variant=True)
        bronze.append(rows_of(spark, people, "players"), at + "t")
        want = [str(v) if isinstance(v, str) else json.dumps(v) for v in ids if v]
        players = sv.players(bronze.parsed_at(spark, at, "s", "players"))
        found = sorted((r["player_id"], r["status"], r["age"]) for r in players.collect())
        assert found == sorted((r["player_id"], r["status"], r["age"]) for r in sv.players(bronze.parsed_at(spark, at + "t", "s", "players")).collect())
        named = [i for i, _, _ in found if not i.startswith("id")]
        assert sorted(named) == sorted({w.replace(" ", "") if w[0] in "[{" else w for w in want})
    plan = players._jdf.queryExecution().optimizedPlan().toString()
    assert "StructsToJson" not in plan


def test_the_incremental_catalog_follows_its_tables_at_once(spark, monkeypatch):
    """The merges of one table don't wait for those of another, and all nine are made."""
    done, merge = [], bs.merge

    def noted(session, path, rows, table="players"):
        done.append((threading.get_ident(), table))
        return merge(session, path, rows, table)

    monkeypatch.setattr(bs, "merge", noted)
    df = E.queries()["catalog_incremental"](spark, SF001)
    assert sorted(t for _, t in done) == sorted(list(bs.KINDS) * 3)
    assert len({i for i, _ in done}) == len(bs.KINDS)
    _equals_oracle(spark, "catalog_incremental", df)


@pytest.mark.parametrize("small", [0, 10**9])
def test_changes_are_counted_with_and_without_a_join(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(bs, "SMALL", small)
    path = str(tmp_path / "silver")
    for batch, (ids, status) in enumerate([(range(30), "Out"), (range(5), "Active"), (range(25, 40), "Active"), ([1, 50], "Out")], 1):
        rows = bronze.records_from_json_column(
            spark.createDataFrame([(json.dumps({"player_id": f"p{i}", "status": status}),) for i in ids], "j string"), "j", "s", "players", batch_id=batch)
        bs.merge(spark, path, bronze.parsed(rows))
        assert bs.counts(spark, path) == bs.recount(spark, path)
    assert bs.counts(spark, path) == {"players": 41, "injuries": 22}
