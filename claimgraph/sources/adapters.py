"""The engine's inputs from the star-schema tables, and JSON text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import BOOL, CID, FLOAT, INTEGER, STRING, list_of, ref
from ..functions.schema import Schema
from ..operators.topology import lineage_nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record in each line, as text in the column `value`: parsing keeps null and absent apart."""
    return spark.read.text(path)


EVENT = Schema("event", 1).identity("user_id", INTEGER).identity("event_type", STRING).required("value", FLOAT)
WRONG_EVENT = Schema("event", 2).identity("user_id", STRING).identity("event_type", STRING).required("value", FLOAT).required("props", STRING)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, record): JSON text with keys in one order or the other, and one key that no schema has."""
    e = table(spark, sf_dir, "events")
    a = F.to_json(F.struct("user_id", "event_type", "value", "props"))
    b = F.to_json(F.struct("props", "value", "event_type", "user_id"))
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("record"))


RICH_EVENT = (
    Schema("event", 3).identity("user_id", INTEGER).optional("value", FLOAT).optional("active", BOOL).optional("source", CID).optional("parent", ref("event"))
    .required("tags", list_of(STRING)).optional("parts", list_of(FLOAT))
)


def rich_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, record): optional fields that are there or not by event_id, and lists of texts, numbers and objects."""
    at = lambda n, k: F.col("event_id") % n == k
    e = F.concat(
        F.lit('{ "tags" : ["'), F.col("event_type"), F.lit('", "t\\u001F\\/" , null,true, {"b":1.0,"a":'), F.col("event_id"), F.lit("}]"),
        F.when(at(2, 0), F.concat(F.lit(',"value":'), F.col("value"))).otherwise(""), F.when(at(3, 0), ',"active":true').otherwise(""),
        F.when(at(5, 1), F.concat(F.lit(',"source":"cid'), F.col("event_id"), F.lit('"'))).otherwise(""), F.when(at(5, 2), ',"parent":"root"').otherwise(""),
        F.when(at(4, 1), F.concat(F.lit(',"parts":[2.50,1e2,'), F.col("event_id"), F.lit(",1E-7, [],[1.0]]"))).otherwise(""),
        F.lit(',"user_id":'), F.col("user_id"), F.lit(',"other":{"x":[1]}}'),
    )
    return table(spark, sf_dir, "events").select("event_id", e.alias("record"))


def bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, record): a record in one of twelve ways wrong, by event_id."""
    id_ = F.col("event_id")
    texts = [
        '{"user_id":"7","tags":[]}', '{"user_id":7.0,"tags":[]}', '{"user_id":null,"tags":[]}', '{"user_id":7,"tags":{}}', '{"user_id":7,"tags":[],"active":[1]}', '{"user_id":7,"tags":[],"value":true}',
        '{"user_id":7}', '{"user_id":7,"tags":[]} trailing', '{"user_id":7,"tags":[],"value":1e400}', "[7]", '{"user_id":18446744073709551616,"tags":[]}', '{"user_id":7,"tags":[],"parent":null}',
    ]
    chosen = F.element_at(F.array(*[F.lit(t) for t in texts]), (id_ % len(texts) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", chosen.alias("record"))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"), F.sha2(F.col("doc_id").cast("string"), 256).alias("node_cid"), F.lit("document").alias("schema_cid"),
        F.sha2("text", 256).alias("identity_hash"), F.col("source").alias("agent"), F.array().cast("array<string>").alias("ancestor_schemas"),
    )


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumns({"ord": F.col("conv_id") * 1000 + F.col("turn"), "agent": F.col("conv_id") % 5})
    return lineage_nodes(c, "conv_id", "turn", "role", "text", "agent", "ord")


TABLES = {
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp o_orderpriority:string",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "region": "r_regionkey:int r_name:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
}


def table_schema(name: str) -> Schema:
    """The schema of a star-schema table; a first column named ...key is its identity."""
    s = Schema(name, 1)
    for i, column in enumerate(TABLES[name].split()):
        field, kind = column.split(":")
        k = {"bigint": INTEGER, "int": INTEGER, "double": FLOAT}.get(kind, STRING)
        s = s.identity(field, k) if i == 0 and field.endswith("key") else s.required(field, k)
    return s


def trade_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of (p_type, p_brand) to (r_name, n_name) by return flag, from line items."""
    t = lambda n: table(spark, sf_dir, n)
    rows = (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    # ord is made of the key: types differ in their first two letters, brands by a number, flags are one letter.
    g = rows.groupBy("p_type", "p_brand", "r_name", "n_name", "n_nationkey", "l_returnflag").agg(F.sum("l_linenumber").alias("s"))
    letter = lambda c, i: F.ascii(F.substring(c, i, 1))
    ord_ = (((letter("p_type", 1) * 128 + letter("p_type", 2)) * 1000 + F.substring("p_brand", 7, 9).cast("long")) * 1000 + F.col("n_nationkey")) * 128 + letter("l_returnflag", 1)
    return g.select(
        ord_.cast("long").alias("ord"), F.col("p_type").alias("source_schema"), F.col("p_brand").alias("source_field"),
        F.col("r_name").alias("target_schema"), F.col("n_name").alias("target_field"), ((F.lit(70) + F.col("s") % 30) / F.lit(100.0)).alias("confidence"),
        F.lit("").alias("justification"), F.col("l_returnflag").alias("agent"),
        F.when(F.col("s") % 20 == 0, "bidirectional").when(F.col("s") % 20 == 1, "reverse").otherwise("forward").alias("direction"),
    )


DOMAINS = [
    (1, "goods_a", 1, ["ECONOMY", "LARGE", "MEDIUM"]), (2, "goods_b", 1, ["MEDIUM", "PROMO", "SMALL"]),
    (3, "west", 1, ["AFRICA", "AMERICA", "EUROPE"]), (4, "east", 1, ["ASIA", "MIDDLE EAST"]),
]


def trade_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "ord long, name string, version long, schema_cids array<string>")


def nation_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of 50 mappings over the 25 nations: i to 7i + 3 and i to i + 5."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.col("n_nationkey").cast("long").alias("i"), F.col("r_name").alias("schema"), F.col("n_name").alias("field"))
    ends = n.select(F.col("i").alias("j"), F.col("schema").alias("target_schema"), F.col("field").alias("target_field"))
    out = n.select("*", F.explode(F.array(F.struct(F.lit(0).alias("k"), ((F.col("i") * 7 + 3) % 25).alias("j")), F.struct(F.lit(1).alias("k"), ((F.col("i") + 5) % 25).alias("j")))).alias("e"))
    rows = out.select((F.col("i") * 2 + F.col("e.k")).alias("ord"), "i", "schema", "field", F.col("e.j").alias("j")).join(ends, "j")
    return rows.select(
        "ord", F.col("schema").alias("source_schema"), F.col("field").alias("source_field"), "target_schema", "target_field",
        ((F.lit(50) + (F.col("i") * 3) % 50) / F.lit(100.0)).alias("confidence"), F.lit("").alias("justification"), F.lit("a").alias("agent"),
        F.when(F.col("i") % 3 == 0, "forward").when(F.col("i") % 3 == 1, "reverse").otherwise("bidirectional").alias("direction"),
    )
