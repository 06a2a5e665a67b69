"""Bronze sink and scan, JSON Lines, quarantine, catalog."""

import json

from pyspark.sql import functions as F

from ingot.plans import silver as sv
from ingot.sources import bronze
from ingot.functions.expr import json_fields


def _write_lines(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_jsonl_tree_load_blank_and_malformed(spark, tmp_path):
    land = tmp_path / "bronze_jsonl"
    _write_lines(land / "src_a" / "players.jsonl", [
        json.dumps({"player_id": "p1", "display_name": "Å non-ascii"}),
        "   ",
        "{not json",
        json.dumps({"player_id": "p2"}),
        "",
    ])
    _write_lines(land / "src_b" / "events.jsonl", [json.dumps({"x": 1})])
    rows = bronze.read_jsonl_tree(spark, str(land))
    counts = {(r.source_id, r.name): r.row_count for r in bronze.catalog(rows).collect()}
    assert counts == {("src_a", "players"): 3, ("src_b", "events"): 1}
    q = bronze.quarantine(rows).collect()
    assert [r.record for r in q] == ["{not json"]
    # the good lines after the bad one are kept, in file order
    good = bronze.parsed(rows.where("tbl = 'players'"))
    out = sv.players(good, json_fields()).orderBy("_first_seq").collect()
    assert [r.player_id for r in out] == ["p1", "p2"]
    assert out[0].name == "Å non-ascii"


def test_append_scan_roundtrip_and_order(spark, tmp_path):
    root = str(tmp_path / "store")
    df1 = spark.createDataFrame([(json.dumps({"player_id": "p1", "display_name": "first"}),)], "j string")
    df2 = spark.createDataFrame([(json.dumps({"player_id": "p1", "display_name": "second"}),)], "j string")
    bronze.append(bronze.records_from_json_column(df1, "j", "s", "players", batch_id=1), root, [("s", "players")])
    bronze.append(bronze.records_from_json_column(df2, "j", "s", "players", batch_id=2), root, [("s", "players")])
    bronze.register_table(spark, root, "s", "empty_table")
    scanned = bronze.scan(spark, root, "s", "players")
    assert scanned.count() == 2
    latest = sv.players(bronze.parsed(scanned), json_fields()).first()
    assert latest.name == "second"
    cat = {(r.source_id, r.name): r.row_count for r in bronze.catalog_at(spark, root).collect()}
    assert cat == {("s", "players"): 2, ("s", "empty_table"): 0}
    assert [json.loads(r.record)["display_name"] for r in bronze.first_rows(scanned, 100).collect()] == ["first", "second"]


def test_sequence_follows_file_order_across_splits(spark, tmp_path):
    """Many small splits: (_file, _block, _pos) still reproduces line order."""
    land = tmp_path / "many"
    lines = [json.dumps({"player_id": "p", "display_name": f"v{i:05d}"}) for i in range(3000)]
    _write_lines(land / "a.jsonl", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = bronze.read_jsonl(spark, str(land / "a.jsonl"), "s", "players", batch_id=1)
        assert rows.rdd.getNumPartitions() > 5
        ordered = [json.loads(r.record)["display_name"] for r in rows.orderBy("_batch_id", "_file", "_block", "_pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ordered == [f"v{i:05d}" for i in range(3000)]


def test_dataframe_records_roundtrip(spark):
    df = spark.createDataFrame([(1, "a", 1.25), (2, None, None)], "id bigint, s string, d double")
    rows = bronze.records_from_dataframe(df, "fx", "t")
    back = bronze.typed(rows, df.schema).drop("_seq")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, "a", 1.25), (2, None, None)]
    assert rows.where(F.col("is_malformed")).count() == 0


def test_export_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    out = str(tmp_path / "export")
    bronze.export_jsonl(bronze.records_from_dataframe(df, "fx", "t"), out)
    back = spark.read.text(out + "/source_id=fx/tbl=t")
    assert [json.loads(r.value) for r in back.collect()] == [{"x": 1}]


def test_two_writers_get_batches_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "store")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: bronze.allocate_batch(spark, root), range(8)))
    assert sorted(got) == list(range(1, 9))
    again = [bronze.allocate_batch(spark, root, "stream-3") for _ in range(3)]
    assert len(set(again)) == 1 and again[0] == 9


def test_a_repeated_append_replaces_its_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = bronze.records_from_dataframe(spark.range(5), "s", "t")
    bronze.append(rows, root, key="a")
    bronze.append(rows, root, key="a")
    bronze.append(rows, root)
    assert bronze.scan(spark, root).count() == 10


def test_tree_names_are_those_of_the_path(spark):
    """Source and table as a pattern on the whole path finds them, without one."""
    files_ = ["file:/r/src/t.jsonl", "file:/r/src/t.jsonl/part-0.txt", "file:/r/a.jsonl/t.jsonl", "file:/r/x.jsonl/src/t.jsonl/p", "file:/r/src/t.v1.jsonl",
              "file:/r/src/t.jsonl.jsonl", "file:/r/src/.jsonl/p", "file:/r/src/t.jsonl/k=1/p", "file:/r/src/t.json", "s/t.jsonl", "t.jsonl/p", "file:/r/s%20c/t.jsonl/p"]
    df = spark.createDataFrame([(f,) for f in files_], "f string")
    src, tbl = bronze._tree_names(F.col("f"))
    pattern = r"([^/]+)/([^/]+)\.jsonl(?:/[^/]+)?$"
    for r in df.select("f", src.alias("s"), tbl.alias("t"), *[F.regexp_extract("f", pattern, i).alias(f"p{i}") for i in (1, 2)]).collect():
        assert (r.s, r.t) == (r.p1, r.p2), r.f
    plan = df.select(src, tbl)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
