"""Canonical text of JSON records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from claimgraph.functions.canonical import Canon, cid, encode_struct, encode_table
from claimgraph.functions.kinds import BOOL, CID, FLOAT, INTEGER, STRING, list_of, ref
from claimgraph.functions.schema import Schema
from test_schema import reading_schema


def encode(spark, schema, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, record string")
    out = encode_table(df, "record", schema, **options).orderBy("i").collect()
    return [(r["canonical"], r["error"]["code"] if r["error"] else None, r["error"]["field"] if r["error"] else None, r["identity"]) for r in out]


def test_records(spark):
    full = '{"weight":0.5,"level":"v","sensor":"p","station":"s"}'
    got = encode(spark, reading_schema(), [
        full,
        '{"station":"s","sensor":"p","level":"v","weight":0.5}',
        '{"station":"s","sensor":"p","level":"v","extra":[1,{"a":2}]}',
        '{"station":"s","sensor":"p"}',
        '{"station":"s","sensor":"p","level":"v","weight":null}',
        '{"station":"s","sensor":"p","level":1}',
        '{"sensor":null,"level":1}',
        "[1]", "null", "3", "{bad", "",
        None,
    ])
    whole = '{"station":"s","sensor":"p","level":"v","weight":0.5}'
    key = '{"station":"s","sensor":"p"}'
    assert got[0] == got[1] == (whole, None, None, key)
    assert got[2] == ('{"station":"s","sensor":"p","level":"v"}', None, None, key)  # absent, not null
    assert got[3] == (None, "missing_field", "level", key)  # projects, though it doesn't encode
    assert got[4] == (None, "type_mismatch", "weight", key)  # an explicit null is a value of the wrong type
    assert got[5] == (None, "type_mismatch", "level", key)
    assert got[6][:3] == (None, "missing_field", "station")  # the first failing field counts
    assert [g[1] for g in got[7:10]] == ["type_mismatch"] * 3 and {g[2] for g in got[7:10]} == {"<root>"}
    assert [g[1] for g in got[10:]] == ["serde"] * 3


def test_messages(spark):
    df = spark.createDataFrame([('{"station":1}',)], "record string")
    e = encode_table(df, "record", reading_schema()).first()["error"]
    assert (e["expected"], e["actual"], e["message"]) == ("String", "number", "field `station` expected String, got number")


def test_integers_and_floats(spark):
    s = Schema("n", 1).optional("i", INTEGER).optional("f", FLOAT)
    good = ['{"i":18446744073709551615}', '{"i":-9223372036854775808}', '{"f":1}', '{"f":1.0}', '{"f":-0.0}', '{"f":0.90}']
    bad = ['{"i":18446744073709551616}', '{"i":-9223372036854775809}', '{"i":1.0}', '{"i":"1"}', '{"f":"1"}', '{"i":true}']
    got = encode(spark, s, good + bad)
    assert [g[0] for g in got[:6]] == ['{"i":18446744073709551615}', '{"i":-9223372036854775808}', '{"f":1}', '{"f":1.0}', '{"f":-0.0}', '{"f":0.9}']
    assert all(g[1] == "type_mismatch" for g in got[6:])


def test_float_exponents(spark):
    s = Schema("n", 1).required("f", FLOAT)
    got = encode(spark, s, ['{"f":1e16}', '{"f":0.00001}', '{"f":10000000.0}', '{"f":1e2}', '{"f":1.5e300}'])
    assert [g[0] for g in got] == ['{"f":1e16}', '{"f":0.00001}', '{"f":10000000.0}', '{"f":100.0}', '{"f":1.5e300}']


def test_lists_are_checked_only_when_strict(spark):
    s = Schema("l", 1).required("xs", list_of(INTEGER))
    text = '{"xs":["a",null,{"b":1,"a":2}]}'
    assert encode(spark, s, [text])[0][0] == text
    assert encode(spark, s, [text, '{"xs":[1,2]}'], strict_lists=True)[0][1] == "type_mismatch"
    assert encode(spark, s, ['{"xs":[1,2]}'], strict_lists=True)[0][0] == '{"xs":[1,2]}'
    assert encode(spark, s, ['{"xs":3}'])[0][1] == "type_mismatch"


def test_lists_print_equal_bytes(spark):
    s = Schema("l", 1).optional("xs", list_of(FLOAT))
    texts = ['{"xs":[1.0, 2.50,1e2 , 18446744073709551615,1E-7,-0.0]}', '{"xs":[{"b":1.0,"a":{"d":2e1,"c":"E1 5"}},"1E5",null]}', '{"xs":["\\u001F\\u000b\\\\u001F\\/é", "\\u0001n5", {"z":"\\u0001u"}]}', '{"xs":[]}']
    same = ['{"xs":[1.0,2.5,100.0,18446744073709551615,1e-7,-0.0]}', None, None, '{"xs":[]}']
    for order, second, third in (
        ("schema", '{"xs":[{"b":1.0,"a":{"d":20.0,"c":"E1 5"}},"1E5",null]}', '{"xs":["\\u001f\\u000b\\\\u001F/é","\\u0001n5",{"z":"\\u0001u"}]}'),
        ("lexicographic", '{"xs":[{"a":{"c":"E1 5","d":20.0},"b":1.0},"1E5",null]}', '{"xs":["\\u001f\\u000b\\\\u001F/é","\\u0001n5",{"z":"\\u0001u"}]}'),
    ):
        got = [g[0] for g in encode(spark, s, texts, key_order=order)]
        assert got == [same[0], second, third, same[3]]
        assert [g[0] for g in encode(spark, s, got, key_order=order)] == got
        for t, g in zip(texts, got):
            assert json.loads(g) == json.loads(t)
    a, b = (encode(spark, s, [t], key_order="lexicographic")[0][0] for t in ('{"xs":[{"b":1,"a":2.0}]}', '{"xs":[{"a":2.0,"b":1}]}'))
    assert a == b == '{"xs":[{"a":2.0,"b":1}]}'


def test_numbers_out_of_range_and_trailing_text(spark):
    s = Schema("t", 1).optional("f", FLOAT).optional("i", INTEGER).optional("t", STRING).optional("xs", list_of(FLOAT))
    bad = ['{"f":1e400}', '{"f":-1e400}', '{"xs":[1e400]}', '{"xs":[1,{"a":-1e999}]}', '{"f":1} trailing', '{"f":1} {"f":2}', '{"f":1},{"f":2}', '{"f":1}] x', '{"f":1}}', '{"f":1}],[{"f":1}', '{"xs":[1]}] }', "[1] x"]
    good = ['{"t":"Infinity"}', '{"xs":["Infinity"]}', ' {"f":1}\n', '{"t":"} {"}', '{"t":"]"}', '{"xs":[{"a":1}]}']
    got = encode(spark, s, bad + good)
    assert [g[1] for g in got[: len(bad)]] == ["serde"] * len(bad)
    assert [g[0] for g in got[len(bad) :]] == [t.strip() for t in good]


def test_expressions_equal_columns(spark):
    s = reading_schema()
    texts = ['{"station":"s","sensor":"p","level":"v","weight":0.5}', '{"station":"s","sensor":"p"}', "[1]", "{bad", '{"station":1}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, record string")
    rows = encode_table(df, "record", s).withColumns({"e": Canon(s).encode(F.col("record")), "p": Canon(s).identity_projection(F.col("record"))}).collect()
    for r in rows:
        assert (r["canonical"], r["error"]) == tuple(r["e"]) and r["identity"] == r["p"]["canonical"]


def test_long_strings_in_lists(spark):
    s = Schema("l", 1).required("xs", list_of(FLOAT))
    text = '{"xs":["%s",1e2,{"b":1,"a":2.50}]}' % ("a\\\\b" * 50_000)
    assert encode(spark, s, [text])[0][0] == text.replace("1e2", "100.0").replace("2.50", "2.5")
    assert encode(spark, s, [text], key_order="lexicographic")[0][0] == text.replace("1e2", "100.0").replace('"b":1,"a":2.50', '"a":2.5,"b":1')


def test_text_in_a_number_field_is_no_exponent(spark):
    s = Schema("n", 1).optional("f", FLOAT).optional("xs", list_of(FLOAT))
    assert [g[1] for g in encode(spark, s, ['{"f":"E"}', '{"f":"1E99999999999"}'])] == ["type_mismatch"] * 2
    assert encode(spark, s, ['{"f":2}'], strict_lists=True)[0][0] == '{"f":2}'


def test_both_orders_of_keys_in_one_pass(spark):
    s = Schema("k", 1).required("b", list_of(FLOAT)).required("a", STRING)
    texts = ['{"b":[{"d":1e2,"c":"\\u001F"}],"a":"x"}', '{"b":[],"a":"x"}', '{"b":[1.50]}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, record string")
    both = encode_table(df, "record", s, orders={"by_name": "lexicographic"})
    got = both.orderBy("i").collect()
    assert [r["canonical"] for r in got] == [g[0] for g in encode(spark, s, texts)]
    assert [r["by_name"] for r in got] == [g[0] for g in encode(spark, s, texts, key_order="lexicographic")]
    assert both._jdf.queryExecution().optimizedPlan().toString().count("parseJson(record") == 1
    with pytest.raises(ValueError):
        encode_table(df, "record", s, orders={"by_name": "any"})


def test_each_member_is_looked_up_once(spark):
    df = spark.createDataFrame([("{}",)], "record string")
    plan = encode_table(df, "record", reading_schema())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get") <= 4 and plan.count("schema_of_variant") + plan.count("schemaOfVariant") <= 5


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([("{}", 1)], "record string, error int")
    with pytest.raises(ValueError, match="error"):
        encode_table(df, "record", reading_schema())


def test_key_order(spark):
    s = Schema("k", 1).required("b", STRING).required("a", STRING).required("Z", STRING)
    text = '{"a":"1","b":"2","Z":"3"}'
    assert encode(spark, s, [text])[0][0] == '{"b":"2","a":"1","Z":"3"}'
    assert encode(spark, s, [text], key_order="lexicographic")[0][0] == '{"Z":"3","a":"1","b":"2"}'
    with pytest.raises(ValueError):
        Canon(s, key_order="any")


def test_duplicate_keys_and_odd_names(spark):
    s = Schema("d", 1).required("a.b", STRING).required("it's", BOOL).optional("", STRING).optional("\\", STRING).optional("r", ref("x")).optional("c", CID)
    got = encode(spark, s, ['{"a.b":"1","a.b":"2","it\'s":true,"r":"any","c":"thing"}'])
    assert got[0][0] == '{"a.b":"2","it\'s":true,"r":"any","c":"thing"}'


def test_no_identity_projects_to_nothing(spark):
    with pytest.warns(UserWarning):
        got = encode(spark, Schema("e", 1).optional("a", STRING), ['{"a":"x"}'])
    assert got[0][3] == "{}"


def test_strings_as_a_json_printer_writes_them(spark):
    r = random.Random(5)
    alphabet = "ab\"\\/\b\f\n\r\t\x00\x01\x1f\x7fé漢😀  "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(200)]
    s = Schema("s", 1).required("v", STRING)
    got = encode(spark, s, [json.dumps({"v": t}) for t in texts])
    for t, g in zip(texts, got):
        assert g[0] == json.dumps({"v": t}, separators=(",", ":"), ensure_ascii=False)
        assert json.loads(g[0]) == {"v": t}


def test_encoding_is_idempotent_and_decodes(spark):
    texts = ['{"level":"v","station":"s","sensor":"p","weight":2}']
    once = encode(spark, reading_schema(), texts)[0][0]
    assert encode(spark, reading_schema(), [once])[0][0] == once
    df = spark.createDataFrame([(once,)], "c string")
    assert df.select(F.variant_get(Canon.decode(F.col("c")), "$.weight", "int")).first()[0] == 2
    assert df.select(cid(F.col("c")).alias("x")).first()["x"] == __import__("hashlib").sha256(once.encode()).hexdigest()


def test_strict_raises(spark):
    df = spark.createDataFrame([("{}",)], "c string")
    with pytest.raises(Exception, match="missing required field: station"):
        df.select(Canon(reading_schema()).strict(F.col("c"))).collect()


def test_typed_columns(spark):
    df = spark.createDataFrame([("s", "p", "v", 0.5), ("s", "p", "v", None), (None, "p", "v", 1.0)], "station string, sensor string, level string, weight double")
    got = [r[0] for r in df.select(encode_struct(reading_schema())).collect()]
    assert got == ['{"station":"s","sensor":"p","level":"v","weight":0.5}', '{"station":"s","sensor":"p","level":"v"}', None]


def test_no_python_worker_in_the_plan(spark):
    df = spark.createDataFrame([("{}",)], "record string")
    plan = encode_table(df, "record", reading_schema())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
