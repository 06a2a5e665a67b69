"""Python truthiness, str(), lenient casts, id lists, key injection."""

import json

import pytest
from pyspark.sql import functions as F

from ingot.functions.expr import (
    Field,
    column_fields,
    inject_keys,
    json_fields,
    parse_id_list,
    stage_fields,
    text_or,
)
from ingot.session import configure

# (JSON text, Python truthiness of json.loads(text))
TRUTH = [
    ('""', False), ('"x"', True), ("0", False), ("0.0", False), ("-0.0", False), ("0.00", False),
    ("1e3", True), ("false", False), ("true", True), ("[]", False), ("{}", False), ("[1]", True),
    ('{"a":1}', True), ("null", False), ('"0"', True), ('"false"', True), ('"[]"', True), ("0e5", False),
    ("25.9", True), ('" "', True),
]


def test_falsy_matches_python(spark):
    df = spark.createDataFrame([(t,) for t, _ in TRUTH], "j string")
    got = dict(df.select("j", Field(F.parse_json("j"), "json").falsy().alias("f")).collect())
    for text, truthy in TRUTH:
        assert got[text] == (not truthy), text
        assert bool(json.loads(text)) == truthy


def test_falsy_absent_field_is_falsy(spark):
    df = spark.createDataFrame([('{"a": 1}',)], "j string")
    r = df.select(Field(F.try_variant_get(F.parse_json("j"), "$.b", "variant"), "json").falsy().alias("f")).first()
    assert r.f is True


def _pid(spark, recs):
    df = spark.createDataFrame([(json.dumps(r),) for r in recs], "j string").select(F.parse_json("j").alias("record_v"))
    from ingot.functions.expr import json_fields

    staged, _ = stage_fields(df, json_fields(), ["player_id", "id"], [])
    return [r[0] for r in staged.select(text_or("player_id", "id", default=None)).collect()]


def test_id_fallback_cases(spark):
    recs = [
        {"player_id": "p1"}, {"player_id": 0}, {"player_id": 0, "id": 0}, {"player_id": None, "id": 0},
        {"player_id": None, "id": "x"}, {"id": ""}, {"player_id": "0"}, {"player_id": "", "id": None}, {},
    ]

    def py(rec):
        pid = rec.get("player_id") or rec.get("id")
        return None if pid is None else str(pid)

    assert _pid(spark, recs) == [py(r) for r in recs]


def test_typed_fields_follow_python(spark):
    df = spark.createDataFrame(
        [("", 0, 0.0, False, []), ("a", 3, 1.5, True, ["x"]), (None, None, None, None, None)],
        "s string, i bigint, d double, b boolean, a array<string>",
    )
    f = column_fields(df)
    out = df.select(*[f(c).falsy().alias(c) for c in df.columns]).collect()
    assert [tuple(r) for r in out] == [(True,) * 5, (False,) * 5, (True,) * 5]
    assert f("missing").kind.simpleString() == "void"


def test_lenient_casts(spark):
    vals = ['25', '"25"', '25.9', '"25.9"', '"abc"', 'true', 'null', '"1.5"', '"nan"', '"inf"', '1e3']
    df = spark.createDataFrame([(v,) for v in vals], "j string").select("j", F.parse_json("j").alias("v"))
    fld = Field(F.col("v"), "json")
    got = {r.j: (r.i, r.d) for r in df.select("j", fld.as_int().alias("i"), fld.as_float().alias("d")).collect()}
    assert got["25"] == (25, 25.0)
    assert got['"25"'] == (25, 25.0)
    assert got["25.9"][0] == 25  # int(25.9) truncates
    assert got['"25.9"'] == (None, 25.9)  # int("25.9") fails in Python too
    assert got['"abc"'] == (None, None)
    assert got["null"] == (None, None)
    assert got['"1.5"'][1] == 1.5
    assert got['"inf"'][1] == float("inf")
    assert got["1e3"] == (1000, 1000.0)


def test_str_array_cleaning(spark):
    vals = ['["p1", null, 2]', '"abc"', 'null', '[]', '5']
    df = spark.createDataFrame([(v,) for v in vals], "j string").select("j", F.parse_json("j").alias("v"))
    got = {r.j: r.a for r in df.select("j", Field(F.col("v"), "json").as_str_array().alias("a")).collect()}
    assert got['["p1", null, 2]'] == ["p1", "2"]
    assert got['"abc"'] == [] and got["null"] == [] and got["[]"] == [] and got["5"] == []


def test_parse_id_list(spark):
    df = spark.createDataFrame([(" L1,L2\n\nL3 ,,",), ("\tA ,A",), ("",)], "s string")
    got = [r[0] for r in df.select(parse_id_list(F.col("s"))).collect()]
    assert got == [["L1", "L2", "L3"], ["A", "A"], []]


@pytest.mark.parametrize(
    "payload,expected",
    [
        ({"name": "x"}, {"league_id": "L1", "name": "x"}),
        ({"league_id": "P", "name": "x"}, {"league_id": "P", "name": "x"}),
        ({"league_id": None}, {"league_id": None}),
    ],
)
def test_key_injection_payload_wins(spark, payload, expected):
    df = spark.createDataFrame([(json.dumps(payload),)], "j string")
    m = F.from_json("j", "map<string,variant>")
    out = df.select(F.to_json(inject_keys(m, league_id=F.lit("L1"))).alias("o")).first().o
    assert json.loads(out) == {"league_id": "L1", **payload} == expected


def test_falsy_casts_only_texts_that_may_be_zero(spark):
    """Zeros of every rendering are falsy, texts like them aren't, and no cast is tried on other texts (each failed one costs an exception)."""
    values = ["0", "-0", "0.0", "-0.0", "0e5", "0.000", '"0"', '"0.0"', '" 0"', '"-0"', '"0d"', '""', '"x"', "7", "false", '"false"', "[]", "{}", '"[]"', "null", "0.5", "true", '"+0"']
    df = spark.createDataFrame([(i, '{"a":' + v + "}") for i, v in enumerate(values)], "i int, j string")
    f = json_fields()("a")
    out = df.select("i", F.try_parse_json("j").alias("record_v")).select("i", f.falsy().alias("x"))
    assert [r.x for r in out.orderBy("i").collect()] == [not json.loads(v) for v in values]
    from ingot.plans import sqlfiles

    sqlfiles.register_functions(spark)
    out = df.select("i", F.try_parse_json("j").alias("v")).selectExpr("i", "falsy(try_variant_get(v, '$.a', 'variant'), try_variant_get(v, '$.a', 'string')) AS x")
    assert [r.x for r in out.orderBy("i").collect()] == [not json.loads(v) for v in values]
    plan = df.select(F.try_parse_json("j").alias("record_v")).select(f.falsy().alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("StartsWith") < plan.index("try_cast")


def test_configure_keeps_methods_the_jvm_compiles(spark):
    old = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    try:
        assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "9000")  # the caller's own stays
        assert configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "9000"
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", old)


def test_numbers_read_straight_from_the_record_equal_cast_values(spark):
    """What a field gives read from the record, or staged with its text, is what its value gives when it is cast."""
    values = [0, 5, -7, 12.9, -0.5, 1e30, 10**18, 10**19, True, False, None, "", "0", "007", "+5", "-3", " 8 ", "9\t", "\u00015", "12.5", "1e3", "n/a", "true",
              "false", "Infinity", "nan", "1d", "x1", "-", "+", "9" * 18, "9" * 19, "9" * 30, "\u0665", [], [1, None, "x"], {}, {"a": 1}]
    lines = [(json.dumps({"age": v, "trending": v, "players": v}), i) for i, v in enumerate(values)] + [("{}", len(values))]
    recs = spark.createDataFrame(lines, "j string, n int").select(F.try_parse_json("j").alias("record_v"), "n")
    f = json_fields()
    age, trending, players = (f(n) for n in ("age", "trending", "players"))
    rows = lambda df: {r.n: str(r) for r in df.collect()}
    named = lambda a, t, *more: (a.alias("a"), t.alias("t"), *more, "n")
    cast = recs.select(*named(age.as_int(age.raw), trending.as_float(trending.raw), players.as_str_array(players.raw).alias("p"), age.text(age.raw).alias("x")))
    direct = recs.select(*named(age.as_int(), trending.as_float(), players.as_str_array().alias("p"), age.text().alias("x")))
    assert rows(direct) == rows(cast)
    assert direct._jdf.queryExecution().optimizedPlan().toString().count("VariantType, false") == 0 < cast._jdf.queryExecution().optimizedPlan().toString().count("VariantType, false")
    staged, s = stage_fields(recs, f, ["age", "trending"], ["n"], {"trending": "double"})
    assert rows(staged.select(*named(s["age"].as_int(), s["trending"].as_float()))) == rows(cast.select("a", "t", "n"))
    plan = staged.select(s["trending"].as_float().alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") == 2  # its text and its number: no VARIANT of its own, no cast of one
