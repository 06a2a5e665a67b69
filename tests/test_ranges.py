"""One JSON document read in byte ranges gives the rows of the one-task parse."""

import json
import random

from ingot.sources import landed, ranges

TRICKY = ['a,b', 'br{ace', '}{][', 'quote " , {', 'back\\slash', '\\', '\\\\",', 'é😀,', "line\nbreak,\ttab", ',', ',,', '', '"', '"}', '\\"']


def documents():
    rng = random.Random(3)
    value = lambda d: rng.choice([lambda: rng.choice(TRICKY), lambda: rng.randrange(99), lambda: None, lambda: True,
                                  lambda: {rng.choice(TRICKY) + str(i): value(d - 1) for i in range(rng.randrange(4))} if d else 1.5,
                                  lambda: [value(d - 1) for _ in range(rng.randrange(4))] if d else []])()
    player = lambda: {"display_name": rng.choice(TRICKY), "meta": value(3), "tags": [rng.choice(TRICKY) for _ in range(rng.randrange(5))]}
    many = {f"p{i},{rng.choice(TRICKY)}": player() if i % 9 else value(2) for i in range(400)}
    return {
        "map": json.dumps(many), "pretty": json.dumps(many, indent=2, ensure_ascii=False), "list": json.dumps([player() for _ in range(300)]),
        "one": json.dumps({"p,1": {"display_name": "A,B"}}), "one_element": json.dumps([{"player_id": "x,y"}]), "two": '{"a":{"b":1},"c":{"d":[2,3]}}\n',
        "empty": "{}", "empty_list": " [ ] ", "spaced": ' \n{ "a" : { "b" : "," } , "c" : { } }\n\n',
        "huge_entry": json.dumps({"a": {"x": "y"}, "big": {"text": "a,{" * 5000}, "z": {"x": "y"}}),
    }


def rows(df):
    df = df.orderBy("_file", "_block", "_pos")
    return [(r["_file"], json.loads(r["record"]) if not r["is_malformed"] else r["record"], r["is_malformed"]) for r in df.collect()]


def test_ranges_give_the_rows_of_one_parse(spark, tmp_path):
    (tmp_path / "players").mkdir()
    docs = documents()
    for name, text in docs.items():
        (tmp_path / "players" / f"{name}.json").write_text(text, encoding="utf-8")
    want = rows(landed.players_snapshot(spark, str(tmp_path)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(docs["map"].encode()) // 16))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert ranges._texts(spark, str(tmp_path / "players" / "map.json")).select("_block").distinct().count() >= 16
        got = rows(landed.players_document(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in docs.items():
        plain = json.loads(text)
        mine, one = ([r[1:] for r in found if r[0].endswith(f"/{name}.json")] for found in (got, want))
        if isinstance(plain, list):
            assert mine == one, name
        else:  # a VARIANT map sorts its keys; byte ranges keep the document's order
            assert sorted(mine, key=str) == sorted(one, key=str), name
            assert [r["player_id"] for r, _ in mine] == [v.get("player_id", k) if isinstance(v, dict) else k for k, v in plain.items()], name


def test_damaged_document_keeps_its_readable_entries(spark, tmp_path):
    (tmp_path / "players").mkdir()
    good = {f"p{i}": {"display_name": f"N{i}"} for i in range(20)}
    (tmp_path / "players" / "cut.json").write_text(json.dumps(good)[:-8], encoding="utf-8")
    (tmp_path / "players" / "whole.json").write_text(json.dumps({"q": {"display_name": "Q"}}), encoding="utf-8")
    (tmp_path / "players" / "bad.json").write_text('{"a": {"x": 1}, "b": {x}, "c": {"x": 2}}', encoding="utf-8")
    got = rows(landed.players_document(spark, str(tmp_path)))
    fine = [r["player_id"] for _, r, bad in got if not bad]
    assert sorted(fine) == sorted([*(f"p{i}" for i in range(19)), "q", "a", "c"])
    assert sum(bad for *_, bad in got) == 2


def test_no_document_no_rows(spark, tmp_path):
    assert landed.players_document(spark, str(tmp_path)).count() == 0
