"""The driver contract, plans, streaming and text sources."""

import duckdb
import pytest

import __spark_entry__ as e
import claimgraph.plans.queries as core
from claimgraph.sources import adapters as src
from claimgraph.streaming.ingest import canonical_stream

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(values) -> list:
    return [round(v, 9) if isinstance(v, float) else v for v in values]


@pytest.mark.parametrize("name", core.queries())
def test_query_equals_sql(spark, sf, duck, name):
    got = core.queries()[name](spark, sf)
    sql = duck.execute(core.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(got.columns)
    expected = sorted((plain(r) for r in sql.fetchall()), key=repr)
    assert sorted((plain(r) for r in got.select(columns).collect()), key=repr) == expected
    assert expected


def test_contract(spark, sf):
    assert set(core.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["schema_cid", "identity_hash", "node_cids", "size", "agent_count"]


def test_scans_read_only_what_they_need(spark, sf):
    plan = core.queries()["cluster_sizes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
    # the engine's own queries stay in the JVM
    for name in ("canonical_events", "disagreements", "domain_bridges"):
        assert "Python" not in core.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_both_key_orders_need_no_join(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").limit(50)
    e.unionByName(e).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))  # each event_id twice
    got = core.queries()["canonical_optional_and_lists"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("parseJson(record") == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = con.execute(core.oracle_sql()["canonical_optional_and_lists"]).fetchall()
    assert len(expected) == 100
    assert sorted(tuple(r) for r in got.select("event_id", "canonical", "cid", "ok", "by_name").collect()) == sorted(expected)


def test_json_lines_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"user_id":1,"event_type":"x","value":2}\n{"value":2,"event_type":"x","user_id":1}\n{"user_id":"1"}\n')
    assert src.json_lines(spark, str(tmp_path / "in")).count() == 3
    stream = spark.readStream.text(str(tmp_path / "in"))
    q = canonical_stream(stream, "value", src.EVENT).select("canonical", "error.code").writeStream.format("memory").queryName("canon").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((tuple(r) for r in spark.table("canon").collect()), key=repr)
    assert got == sorted([('{"user_id":1,"event_type":"x","value":2}', None)] * 2 + [(None, "type_mismatch")], key=repr)


def test_stream_keeps_each_content_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"user_id":1,"event_type":"x","value":2}\n{"value":2,"event_type":"x","user_id":1}\n{"user_id":"1"}\n')
    from pyspark.sql import functions as F

    stream = spark.readStream.text(str(tmp_path / "in")).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    q = canonical_stream(stream, "value", src.EVENT, "at").select("canonical").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r[0] for r in spark.table("once").collect()] == ['{"user_id":1,"event_type":"x","value":2}']
