"""The Python source's byte ranges, pushed filters and commit protocol."""

import json

import pytest
from pyspark.sql import functions as F

from ingot.sources import datasources as ds
from ingot.sources import ingest as ing

LINES = [json.dumps({"n": i, "t": "é😀 " * (i % 7)}, ensure_ascii=False) for i in range(900)]


@pytest.fixture()
def reader(spark):
    name = ing.register_datasource(spark, ds.JsonLineFiles)
    return lambda path, **options: ing.get_source(name)(spark, path=path, **options)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(LINES), encoding="utf-8")  # without a line end at the end
    (tmp_path / "in" / "sub" / "b.jsonl").write_text('{"b": 1}\n\n   \n{"b": 2}\r\n', encoding="utf-8")
    (tmp_path / "in" / "empty.jsonl").write_text("")
    (tmp_path / "in" / "_hidden").write_text("no")
    return tmp_path / "in"


def test_any_cut_reads_every_line_once(folder):
    whole = (folder / "a.jsonl").read_bytes()
    for split in (1, 7, 100, 1000, len(whole) - 1, len(whole), 1 << 20):
        reader = ds._Reader(str(folder), split) if split >= 100 else ds._Reader(str(folder / "sub"), split)
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        mine = [r for r in rows if r[0].endswith("a.jsonl")]
        if split >= 100:
            assert [r[3] for r in mine] == LINES
            assert all(whole[r[2] :].startswith(r[3].encode()) and r[1] <= r[2] < r[1] + split for r in mine)
        assert [json.loads(r[3]) for r in rows if r[0].endswith("b.jsonl")] == [{"b": 1}, {"b": 2}]


def test_one_file_is_read_by_eight_tasks(reader, folder):
    size = (folder / "a.jsonl").stat().st_size
    rows = reader(str(folder), splitBytes=-(-size // 8)).where(F.col("_file").endswith("a.jsonl"))
    assert rows.select("_block").distinct().count() == 8
    assert [r["record"] for r in rows.orderBy("_file", "_block", "pos").collect()] == LINES


def test_filters_reach_the_reader(reader, folder):
    rows = reader(str(folder))
    one = rows.where((F.col("_file") == str(folder / "a.jsonl")) & F.col("record").contains('"n": 77') & F.col("record").startswith("{"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "FilterExec" not in plan and "+- Filter" not in plan  # the source has taken all of them
    assert sorted(json.loads(r["record"])["n"] for r in one.collect()) == [77, *range(770, 780)]
    assert rows.where("_file = 'nowhere'").count() == 0
    left = rows.where(F.col("pos") > 10)  # not one of the source's: Spark filters
    assert left.count() == 901 - 1


def test_pushed_files_make_no_other_partitions(folder):
    reader = ds._Reader(str(folder), 100)
    rest = list(reader.pushFilters([ds.EqualTo(("_file",), str(folder / "sub" / "b.jsonl")), ds.IsNotNull(("record",)), ds.EqualTo(("pos",), 3)]))
    assert rest == [ds.EqualTo(("pos",), 3)]
    assert {p.path for p in reader.partitions()} == {str(folder / "sub" / "b.jsonl")}


def shown(folder):
    return sorted(p for p in folder.rglob("*") if p.is_file() and not p.name.startswith("."))


def test_write_and_read_back(spark, reader, tmp_path):
    out = tmp_path / "out"
    rows = spark.range(500, numPartitions=5).select(F.to_json(F.struct("id")).alias("record"))
    rows.write.format("json_line_files").mode("append").save(str(out))
    rows.limit(3).write.format("json_line_files").mode("append").save(str(out))
    assert reader(str(out)).count() == 503
    assert not list((out / ds.STAGING).glob("*"))
    order = [json.loads(r["record"])["id"] for r in reader(str(out)).orderBy("_file", "_block", "pos").collect()]
    assert sorted(order) == sorted([*range(500), 0, 1, 2])
    rows.limit(7).write.format("json_line_files").mode("overwrite").save(str(out))
    assert reader(str(out)).count() == 7


def test_a_failed_write_leaves_nothing(spark, reader, tmp_path):
    out = tmp_path / "out"
    good = spark.range(10).select(F.to_json(F.struct("id")).alias("record"))
    good.write.format("json_line_files").mode("append").save(str(out))
    before = shown(out)
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, "two\nlines").otherwise("{}").alias("record"))
    with pytest.raises(Exception, match="line end"):
        bad.write.format("json_line_files").mode("append").save(str(out))
    assert shown(out) == before and reader(str(out)).count() == 10


def test_of_two_attempts_the_committed_one_counts(tmp_path):
    writer = ds._Writer(str(tmp_path), False)
    lost = writer.write(iter([{"record": "{}"}]))  # a task whose executor was lost after it wrote
    again = writer.write(iter([{"record": "{}"}, {"record": '{"a": 1}'}]))
    assert lost.path != again.path
    writer.commit([again, writer.write(iter([]))])
    assert len(shown(tmp_path)) == 1 and shown(tmp_path)[0].read_text() == '{}\n{"a": 1}\n'
