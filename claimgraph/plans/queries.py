"""Queries of the core library, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import Canon, encode_table
from ..functions.canonical import cid as content_id
from ..functions.kinds import BOOL, CID, FLOAT, INTEGER, STRING, list_of, ref
from ..functions.schema import Schema, field_table, identity_fields
from ..operators import align as al
from ..operators import bridge, closure, domains, mappings
from ..operators.topology import Topology
from ..sources import adapters as src

KEY = ", ".join(mappings.KEY)


def joined(c, sep: str = ","):
    return F.array_join(c, sep)


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(src.event_records(spark, sf_dir), "record", src.EVENT).select("event_id", "canonical", "cid")


def identity_projection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(src.event_records(spark, sf_dir), "record", src.EVENT).select("event_id", "identity", "identity_hash")


def canonical_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(src.event_records(spark, sf_dir), "record", src.WRONG_EVENT).select("event_id", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


def event_identity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonicalise, project, cluster: how many records share an identity."""
    rows = encode_table(src.event_records(spark, sf_dir), "record", src.EVENT)
    return rows.groupBy("identity").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("cid").alias("contents"))


def clusters_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Topology(src.document_nodes(spark, sf_dir)).clusters().withColumn("node_cids", joined("node_cids"))


def convergent_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Topology(src.document_nodes(spark, sf_dir)).convergent_clusters().withColumn("node_cids", joined("node_cids"))


def cooccurrence_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Topology(src.conversation_nodes(spark, sf_dir)).co_occurrences()


def topology_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Topology(src.conversation_nodes(spark, sf_dir))
    return t.schema_count().crossJoin(t.cluster_count())


def nodes_of_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Topology(src.conversation_nodes(spark, sf_dir)).nodes_of_schema("assistant").select("ord", "node_cid", "agent")


def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Topology(src.document_nodes(spark, sf_dir)).dedup_stats()


def latest_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Topology(src.document_nodes(spark, sf_dir)).latest_by_identity()


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Topology(src.document_nodes(spark, sf_dir)).cluster_sizes()


def _candidates(spark: SparkSession) -> DataFrame:
    return al.align(al.fields_of(spark, src.table_schema("customer")), al.fields_of(spark, src.table_schema("supplier")))


def align_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark)
    return c.select("source_field", "target_field", F.round("confidence", 9).alias("confidence"), F.round("rationale.name_score", 9).alias("name_score"), "rationale.type_score", "rationale.identity_score")


def align_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = al.candidates_to_mappings(_candidates(spark), "aligner")
    return m.select("source_field", "target_field", F.round("confidence", 9).alias("confidence"), "justification", "agent", "direction")


def mapping_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mappings.reversed_mappings(src.trade_mappings(spark, sf_dir))


def mapping_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mappings.by_key(src.trade_mappings(spark, sf_dir))


def mapping_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To JSON and back: the rows again, with no error."""
    m = src.trade_mappings(spark, sf_dir).select("ord", mappings.to_json().alias("j"))
    return mappings.from_json(m, "j").select("ord", *mappings.KEY, "confidence", "agent", "direction", F.col("error").isNull().alias("ok"))


def mapping_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings as records of their own schema: identity of each, and how many distinct contents it has."""
    m = src.trade_mappings(spark, sf_dir).select(mappings.to_json().alias("j"))
    rows = encode_table(m, "j", mappings.mapping_schema())
    return rows.groupBy("identity").agg(F.count_distinct("cid").alias("contents"), F.min(content_id(F.col("identity"))).alias("identity_hash"))


def domain_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.membership(src.trade_domains(spark))


def domain_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = src.trade_domains(spark)
    more = domains.with_schema(F.col("schema_cids"), F.lit("MEDIUM"))
    return d.select("name", joined(more).alias("with_medium"), F.array_contains("schema_cids", "MEDIUM").alias("has_medium"), F.size("schema_cids").alias("schema_count"), domains.canonical_text().alias("canonical"))


def domain_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bridge.domain_bridges(src.trade_mappings(spark, sf_dir), src.trade_domains(spark))
    return b.withColumn("avg_confidence", F.round("avg_confidence", 9))


def _terms(c):
    return joined(F.transform(c, lambda m: F.concat_ws("/", m["ord"].cast("string"), m["agent"], m["direction"])))


def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.disagreements(src.trade_mappings(spark, sf_dir)).withColumn("competing", _terms("competing"))


def convergent_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.convergent_mappings(src.trade_mappings(spark, sf_dir)).drop("justification")


def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = closure.transitive_closure(src.nation_mappings(spark, sf_dir), "AFRICA", "NATION_0", 4)
    steps = joined(F.transform("steps", lambda s: F.concat(s["schema"], F.lit("."), s["field"])), ">")
    return c.select("schema", "field", steps.alias("steps"), "hops", F.round("confidence", 9).alias("confidence"))


def canonical_optional_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional fields, references and lists, in both key orders."""
    rows = encode_table(src.rich_records(spark, sf_dir), "record", src.RICH_EVENT, orders={"by_name": "lexicographic"})
    return rows.select("event_id", "canonical", "cid", F.col("error").isNull().alias("ok"), "by_name")


def canonical_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_table(src.bad_records(spark, sf_dir), "record", src.RICH_EVENT)
    return rows.select("event_id", "canonical", F.col("error.code").alias("code"), F.col("error.message").alias("message"))


def canonical_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that canonical text gives back."""
    v = Canon.decode(F.col("canonical"))
    rows = encode_table(src.event_records(spark, sf_dir), "record", src.EVENT)
    return rows.select("event_id", F.variant_get(v, "$.user_id", "bigint").alias("user_id"), F.variant_get(v, "$.event_type", "string").alias("event_type"), F.variant_get(v, "$.value", "double").alias("value"))


def _schemas() -> list:
    return [src.table_schema(n) for n in src.TABLES] + [src.RICH_EVENT]


def schema_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical bytes and content ids of schemas, and what is read back from them."""
    back = [Schema.from_json(s.canonical_text()) for s in _schemas()]
    rows = [(s.name, s.version, s.to_canonical_bytes().decode(), s.cid(), len(b.fields), b == s) for s, b in zip(_schemas(), back)]
    return spark.createDataFrame(rows, "name string, version long, canonical string, cid string, n_fields int, same boolean")


def schema_identity_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity fields of a catalog table, with their kinds as text."""
    return identity_fields(field_table(spark, _schemas())).select("schema_cid", "ord", "name", "kind", "required")


def mapping_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults for what is missing, confidences into [0, 1]."""
    gone = lambda n, k, c: F.when(F.col("ord") % n != k, F.col(c)).alias(c)
    m = src.trade_mappings(spark, sf_dir).select(
        "ord", *mappings.KEY, F.when(F.col("ord") % 5 != 0, F.col("confidence") * 4 - 3).alias("confidence"), gone(3, 0, "justification"), gone(7, 1, "agent"), gone(11, 2, "direction"))
    return mappings.normalise(m)


def mapping_bad_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with texts that aren't mappings."""
    j, at = F.col("j"), lambda k: F.col("ord") % 8 == k
    spoilt = (
        F.when(at(0), F.lit("[1]")).when(at(1), F.lit("{")).when(at(2), F.replace(j, F.lit('"direction":"'), F.lit('"direction":"x'))).when(at(3), F.replace(j, F.lit('"direction"'), F.lit('"d"')))
        .when(at(4), F.replace(j, F.lit('"confidence":'), F.lit('"confidence":"a","c":'))).when(at(5), F.replace(j, F.lit('"source_field":"'), F.lit('"source_field":1,"s":"'))).when(at(6), F.concat(j, F.lit(" x"))).otherwise(j)
    )
    m = src.trade_mappings(spark, sf_dir).select("ord", mappings.to_json().alias("j")).select("ord", spoilt.alias("j"))
    return mappings.from_json(m, "j").select("ord", "source_field", "agent", F.col("error.code").alias("code"), F.col("error.field").alias("field"), F.col("error.message").alias("message"))


def _every_kind() -> list:
    return [STRING, INTEGER, FLOAT, BOOL, CID, ref("a"), ref("b"), list_of(INTEGER), list_of(FLOAT), list_of(list_of(STRING)), list_of(list_of(CID)), list_of(ref("a"))]


def align_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type scores of all pairs of kinds, between fields that are named alike."""
    a, b = Schema("a", 1), Schema("b", 1)
    for i, k in enumerate(_every_kind()):
        a, b = a.required(f"x{i:02}", k), b.required(f"y{i:02}", k)
    c = al.align(al.fields_of(spark, a), al.fields_of(spark, b), al.AlignConfig(min_confidence=0.0))
    return c.select("source_field", "target_field", "rationale.type_score")


ALL = (
    canonical_optional_and_lists, canonical_bad_records, canonical_decode, schema_bytes, schema_identity_fields, mapping_normalised, mapping_bad_json, align_kinds,
    canonical_events, identity_projection_events, canonical_errors, event_identity_clusters, clusters_documents, convergent_clusters,
    cooccurrence_conversations, topology_counts, nodes_of_schema, dedup_stats, latest_by_identity, cluster_sizes, align_tables, align_mappings,
    mapping_reversed, mapping_identity, mapping_json, mapping_content_ids, domain_membership, domain_sets, domain_bridges, disagreements,
    convergent_mappings, transitive_closure,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


NODES = "nodes AS (SELECT doc_id AS ord, sha256(CAST(doc_id AS VARCHAR)) AS node_cid, 'document' AS schema_cid, sha256(text) AS identity_hash, source AS agent FROM documents)"
CONV = "nodes AS (SELECT conv_id * 1000 + turn AS ord, sha256(CAST(conv_id * 1000 + turn AS VARCHAR)) AS node_cid, role AS schema_cid, sha256(text) AS identity_hash, CAST(conv_id % 5 AS VARCHAR) AS agent, conv_id, turn FROM conversations)"
CLUSTERS = f"""WITH {NODES}, a AS (SELECT m.schema_cid, m.identity_hash, count(DISTINCT n.agent) AS agent_count FROM nodes m JOIN nodes n USING (node_cid) GROUP BY ALL),
    c AS (SELECT schema_cid, identity_hash, string_agg(node_cid, ',' ORDER BY ord) AS node_cids, count(*) AS size FROM nodes GROUP BY ALL)
    SELECT c.*, agent_count FROM c JOIN a USING (schema_cid, identity_hash)"""
EVENT_TEXT = """'{"user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || CAST(value AS VARCHAR) || '}'"""
EVENT_ID = """'{"user_id":' || user_id || ',"event_type":"' || event_type || '"}'"""
MAPPINGS = """m AS (SELECT CAST((((ascii(p_type) * 128 + ascii(substr(p_type, 2, 1))) * 1000 + CAST(substr(p_brand, 7) AS BIGINT)) * 1000 + n_nationkey) * 128 + ascii(l_returnflag) AS BIGINT) AS ord, p_type AS source_schema, p_brand AS source_field,
      r_name AS target_schema, n_name AS target_field, (70 + s % 30) / 100.0::DOUBLE AS confidence, '' AS justification, l_returnflag AS agent,
      CASE WHEN s % 20 = 0 THEN 'bidirectional' WHEN s % 20 = 1 THEN 'reverse' ELSE 'forward' END AS direction
    FROM (SELECT p_type, p_brand, r_name, n_name, n_nationkey, l_returnflag, sum(l_linenumber)::BIGINT AS s FROM lineitem JOIN part ON l_partkey = p_partkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL))"""
DOMAINS = "d AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, '{n}', {v}, {ids})" for o, n, v, ids in src.DOMAINS) + ") AS t(ord, name, version, ids))"
MEMBERS = f"{DOMAINS}, mem AS (SELECT id AS schema_cid, arg_max(name, ord) AS domain FROM (SELECT ord, name, unnest(ids) AS id FROM d) GROUP BY id)"


def _fields(name: str) -> str:
    s = src.table_schema(name)
    return ", ".join(f"({i}, '{f.name}', '{f.kind.name}', {f.identity})" for i, f in enumerate(s.fields))


ALIGN = f"""WITH s AS (SELECT * FROM (VALUES {_fields("customer")}) AS t(o, n, k, i)), t AS (SELECT * FROM (VALUES {_fields("supplier")}) AS t(o, n, k, i)),
    p AS (SELECT s.n AS a, t.n AS b, least(1.0::DOUBLE, 1.0::DOUBLE - levenshtein(lower(s.n), lower(t.n))::DOUBLE / greatest(strlen(s.n), strlen(t.n)) + CASE WHEN contains(lower(s.n), lower(t.n)) OR contains(lower(t.n), lower(s.n)) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) AS ns,
      CASE WHEN s.k = t.k THEN 1.0::DOUBLE WHEN least(s.k, t.k) = 'float' AND greatest(s.k, t.k) = 'integer' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS ts,
      CASE WHEN s.i = t.i THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS i FROM s, t),
    q AS (SELECT *, 0.4::DOUBLE * ns + 0.4::DOUBLE * ts + 0.2::DOUBLE * i AS c FROM p)"""
GROUPS = f"""g AS (SELECT {KEY}, string_agg(ord || '/' || agent || '/' || direction, ',' ORDER BY ord) AS competing, count(DISTINCT agent) AS agent_count,
      max(confidence) - min(confidence) AS spread, count(DISTINCT direction) AS directions, arg_max({{'ord': ord, 'confidence': confidence, 'agent': agent, 'direction': direction}}, {{'c': confidence, 'o': ord}}) AS best FROM m GROUP BY ALL)"""
CLOSURE = """WITH RECURSIVE n AS (SELECT n_nationkey AS i, r_name AS s, n_name AS f FROM nation JOIN region ON n_regionkey = r_regionkey),
    m AS (SELECT x.i * 2 + k AS ord, x.s AS ss, x.f AS sf, y.s AS ts, y.f AS tf, (50 + (x.i * 3) % 50) / 100.0::DOUBLE AS c, ['forward', 'reverse', 'bidirectional'][x.i % 3 + 1] AS dir
      FROM n x, (VALUES (0), (1)) AS v(k), n y WHERE y.i = CASE k WHEN 0 THEN (x.i * 7 + 3) % 25 ELSE (x.i + 5) % 25 END),
    k AS (SELECT ss, sf, ts, tf, arg_min(c, ord) AS there, arg_min(c, ord) FILTER (WHERE dir <> 'forward') AS back FROM m GROUP BY ALL),
    e AS (SELECT ss AS s1, sf AS f1, ts AS s2, tf AS f2, there AS c, ss || chr(1) || sf || chr(1) || ts || chr(1) || tf || chr(1) || '0' AS key FROM k
      UNION ALL SELECT ts, tf, ss, sf, back, ss || chr(1) || sf || chr(1) || ts || chr(1) || tf || chr(1) || '1' FROM k WHERE back IS NOT NULL),
    w AS (SELECT 'AFRICA' AS s, 'NATION_0' AS f, ['AFRICA.NATION_0'] AS path, 0 AS hops, 1.0::DOUBLE AS c, '' AS keys
      UNION ALL SELECT e.s2, e.f2, list_append(w.path, e.s2 || '.' || e.f2), hops + 1, w.c * e.c, w.keys || chr(2) || e.key FROM w JOIN e ON e.s1 = w.s AND e.f1 = w.f
        WHERE hops < 4 AND NOT list_contains(w.path, e.s2 || '.' || e.f2)),
    b AS (SELECT s, f, arg_min({'p': path, 'h': hops, 'c': c}, hops || keys) AS x FROM w WHERE hops > 0 GROUP BY s, f)
    SELECT s AS schema, f AS field, array_to_string(x.p, '>') AS steps, x.h AS hops, round(x.c, 9) AS confidence FROM b"""


def _rich_sql() -> str:
    """The records' canonical text, put together from the columns."""
    esc = "\\u001f/"
    opt = lambda cond, text: f"CASE WHEN event_id % {cond[0]} = {cond[1]} THEN {text} ELSE '' END"
    value = opt((2, 0), """',"value":' || CAST(value AS VARCHAR)""")
    active, parent = opt((3, 0), """',"active":true'"""), opt((5, 2), """',"parent":"root"'""")
    source = opt((5, 1), """',"source":"cid' || event_id || '"'""")
    tags = lambda o: f"""'"tags":["' || event_type || '","t{esc}",null,true,' || {o} || ']'"""
    plain, ordered = """'{"b":1.0,"a":' || event_id || '}'""", """'{"a":' || event_id || ',"b":1.0}'"""
    parts = opt((4, 1), """',"parts":[2.5,100.0,' || event_id || ',1e-7,[],[1.0]]'""")
    cut = lambda x: f"substr({x}, 2) || CASE WHEN {x} = '' THEN '' ELSE ',' END"
    canonical = f"""'{{"user_id":' || user_id || {value} || {active} || {source} || {parent} || ',' || {tags(plain)} || {parts} || '}}'"""
    before = f"({active} || {parent} || {parts} || {source})"
    by_name = f"""'{{' || {cut(before)} || {tags(ordered)} || ',"user_id":' || user_id || {value} || '}}'"""
    return f"SELECT event_id, {canonical} AS canonical, sha256({canonical}) AS cid, true AS ok, {by_name} AS by_name FROM events"


def _bad_sql() -> str:
    wrong = [
        ("type_mismatch", "field `user_id` expected Integer, got string"), ("type_mismatch", "field `user_id` expected Integer, got number"), ("type_mismatch", "field `user_id` expected Integer, got null"),
        ("type_mismatch", "field `tags` expected List(String), got object"), ("type_mismatch", "field `active` expected Bool, got array"), ("type_mismatch", "field `value` expected Float, got bool"),
        ("missing_field", "missing required field: tags"), ("serde", "serialization error: not JSON"), ("serde", "serialization error: number out of range"), ("type_mismatch", "field `<root>` expected object, got array"),
        ("type_mismatch", "field `user_id` expected Integer, got number"), ("type_mismatch", 'field `parent` expected Ref("event"), got null'),
    ]
    rows = ", ".join(f"({i}, '{c}', '{m}')" for i, (c, m) in enumerate(wrong))
    return f"SELECT event_id, CAST(NULL AS VARCHAR) AS canonical, code, message FROM events JOIN (VALUES {rows}) AS w(i, code, message) ON event_id % {len(wrong)} = i"


def _schema_rows() -> str:
    """VALUES (schema, version, ord, name, kind as JSON, required, identity), written from the adapters' column lists."""
    rows = []
    for n, columns in src.TABLES.items():
        for i, c in enumerate(columns.split()):
            name, kind = c.split(":")
            k = {"bigint": "integer", "int": "integer", "double": "float"}.get(kind, "string")
            rows.append((n, 1, i, name, f'"{k}"', True, i == 0 and name.endswith("key")))
    rich = [("user_id", '"integer"', True, True), ("value", '"float"', False, False), ("active", '"bool"', False, False), ("source", '"cid"', False, False), ("parent", '{"ref":"event"}', False, False),
            ("tags", '{"list":"string"}', True, False), ("parts", '{"list":"float"}', False, False)]
    rows += [("event", 3, i, *r) for i, r in enumerate(rich)]
    return "f AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {v}, {i}, '{n}', '{k}', {r}, {d})" for s, v, i, n, k, r, d in rows) + ") AS t(s, v, ord, name, kind, required, identity))"


SCHEMA_TEXT = """t AS (SELECT s, v, count(*) AS n, '{"name":"' || s || '","version":' || v || ',"fields":[' ||
    string_agg('{"name":"' || name || '","kind":' || kind || ',"required":' || required || ',"identity":' || identity || '}', ',' ORDER BY ord) || ']}' AS c FROM f GROUP BY s, v)"""


def _align_kinds_sql() -> str:
    """By the rule in SQL: equal list depths off, then equal 1, integer and float or text and content id 0.5, reference and content id 0.3."""
    kinds = [(0, "string"), (0, "integer"), (0, "float"), (0, "bool"), (0, "cid"), (0, "ref:a"), (0, "ref:b"), (1, "integer"), (1, "float"), (2, "string"), (2, "cid"), (1, "ref:a")]
    rows = ", ".join(f"({i}, {d}, '{k}')" for i, (d, k) in enumerate(kinds))
    return f"""WITH k AS (SELECT * FROM (VALUES {rows}) AS t(i, d, k)), p AS (SELECT a.i AS i, b.i AS j, a.d = b.d AS deep, least(a.k, b.k) AS x, greatest(a.k, b.k) AS y FROM k a, k b)
        SELECT printf('x%02d', i) AS source_field, printf('y%02d', j) AS target_field, CASE WHEN NOT deep THEN 0.0 WHEN x = y THEN 1.0 WHEN x = 'float' AND y = 'integer' OR x = 'cid' AND y = 'string' THEN 0.5
          WHEN x = 'cid' AND starts_with(y, 'ref:') THEN 0.3 ELSE 0.0 END::DOUBLE AS type_score FROM p"""


def oracle_sql() -> dict[str, str]:
    return {
        "canonical_optional_and_lists": _rich_sql(),
        "canonical_bad_records": _bad_sql(),
        "canonical_decode": "SELECT event_id, user_id, event_type, value FROM events",
        "schema_bytes": f"WITH {_schema_rows()}, {SCHEMA_TEXT} SELECT s AS name, CAST(v AS BIGINT) AS version, c AS canonical, sha256(c) AS cid, CAST(n AS INTEGER) AS n_fields, true AS same FROM t",
        "schema_identity_fields": f"WITH {_schema_rows()}, {SCHEMA_TEXT} SELECT sha256(c) AS schema_cid, ord, name, kind, required FROM f JOIN t USING (s, v) WHERE identity",
        "mapping_normalised": f"""WITH {MAPPINGS} SELECT ord, {KEY}, CASE WHEN ord % 5 = 0 THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence * 4 - 3)) END AS confidence, '' AS justification,
            CASE WHEN ord % 7 = 1 THEN 'unknown' ELSE agent END AS agent, CASE WHEN ord % 11 = 2 THEN 'forward' ELSE direction END AS direction FROM m""",
        "mapping_bad_json": f"""WITH {MAPPINGS}, x AS (SELECT *, ord % 8 AS k FROM m) SELECT ord, CASE WHEN k IN (2, 3, 4, 7) THEN source_field END AS source_field, CASE WHEN k NOT IN (0, 1, 6) THEN agent END AS agent,
            CASE k WHEN 0 THEN 'type_mismatch' WHEN 1 THEN 'serde' WHEN 2 THEN 'type_mismatch' WHEN 6 THEN 'serde' WHEN 7 THEN NULL ELSE 'missing_field' END AS code,
            CASE k WHEN 0 THEN '<root>' WHEN 2 THEN 'direction' WHEN 3 THEN 'direction' WHEN 4 THEN 'confidence' WHEN 5 THEN 'source_field' END AS field,
            CASE k WHEN 0 THEN 'expected JSON object' WHEN 1 THEN 'serialization error: not JSON' WHEN 2 THEN 'invalid direction: x' || direction WHEN 3 THEN 'missing or invalid field: direction'
              WHEN 4 THEN 'missing or invalid field: confidence' WHEN 5 THEN 'missing or invalid field: source_field' WHEN 6 THEN 'serialization error: not JSON' END AS message FROM x""",
        "align_kinds": _align_kinds_sql(),
        "canonical_events": f"SELECT event_id, {EVENT_TEXT} AS canonical, sha256({EVENT_TEXT}) AS cid FROM events",
        "identity_projection_events": f"SELECT event_id, {EVENT_ID} AS identity, sha256({EVENT_ID}) AS identity_hash FROM events",
        "canonical_errors": "SELECT event_id, 'type_mismatch' AS code, 'field `user_id` expected String, got number' AS message FROM events",
        "event_identity_clusters": f"SELECT {EVENT_ID} AS identity, count(*) AS records, count(DISTINCT {EVENT_TEXT}) AS contents FROM events GROUP BY 1",
        "clusters_documents": CLUSTERS,
        "convergent_clusters": CLUSTERS + " WHERE agent_count > 1",
        "cooccurrence_conversations": f"WITH {CONV} SELECT least(x.schema_cid, y.schema_cid) AS schema_a, greatest(x.schema_cid, y.schema_cid) AS schema_b, count(*) AS count FROM nodes x JOIN nodes y ON x.conv_id = y.conv_id AND y.turn < x.turn AND x.schema_cid <> y.schema_cid GROUP BY 1, 2",
        "topology_counts": f"WITH {CONV} SELECT count(DISTINCT schema_cid) AS schema_count, count(DISTINCT (schema_cid, identity_hash)) AS cluster_count FROM nodes",
        "nodes_of_schema": f"WITH {CONV} SELECT ord, node_cid, agent FROM nodes WHERE schema_cid = 'assistant'",
        "dedup_stats": f"WITH {NODES} SELECT schema_cid, count(*) AS nodes, count(DISTINCT node_cid) AS distinct_cids, count(DISTINCT identity_hash) AS distinct_identities, count(*)::DOUBLE / count(DISTINCT identity_hash) AS ratio FROM nodes GROUP BY 1",
        "latest_by_identity": f"WITH {NODES} SELECT schema_cid, identity_hash, max(ord) AS ord, arg_max(node_cid, ord) AS node_cid, arg_max(agent, ord) AS agent FROM nodes GROUP BY 1, 2",
        "cluster_sizes": f"WITH {NODES} SELECT size, count(*) AS clusters FROM (SELECT count(*) AS size FROM nodes GROUP BY schema_cid, identity_hash) GROUP BY 1",
        "align_tables": ALIGN + " SELECT a AS source_field, b AS target_field, round(c, 9) AS confidence, round(ns, 9) AS name_score, ts AS type_score, i AS identity_score FROM q WHERE c >= 0.3::DOUBLE",
        "align_mappings": ALIGN + " SELECT a AS source_field, b AS target_field, round(c, 9) AS confidence, 'structural alignment: name=' || printf('%.2f', ns) || ', type=' || printf('%.2f', ts) || ', identity=' || printf('%.2f', i) AS justification, 'aligner' AS agent, 'forward' AS direction FROM q WHERE c >= 0.3::DOUBLE",
        "mapping_reversed": f"WITH {MAPPINGS} SELECT ord, target_schema AS source_schema, target_field AS source_field, source_schema AS target_schema, source_field AS target_field, confidence, justification, agent, CASE direction WHEN 'forward' THEN 'reverse' WHEN 'reverse' THEN 'forward' ELSE direction END AS direction FROM m",
        "mapping_identity": f"WITH {MAPPINGS} SELECT {KEY}, count(*) AS count FROM m GROUP BY ALL",
        "mapping_json": f"WITH {MAPPINGS} SELECT ord, {KEY}, confidence, agent, direction, true AS ok FROM m",
        "mapping_content_ids": f"""WITH {MAPPINGS}, x AS (SELECT '{{"source_schema":"' || source_schema || '","source_field":"' || source_field || '","target_schema":"' || target_schema || '","target_field":"' || target_field || '"}}' AS identity, confidence, agent, direction FROM m)
            SELECT identity, count(DISTINCT (confidence, agent, direction)) AS contents, min(sha256(identity)) AS identity_hash FROM x GROUP BY identity""",
        "domain_membership": f"WITH {MEMBERS} SELECT schema_cid, domain FROM mem",
        "domain_sets": f"""WITH {DOMAINS} SELECT name, array_to_string(list_sort(list_distinct(list_append(ids, 'MEDIUM'))), ',') AS with_medium, list_contains(ids, 'MEDIUM') AS has_medium, len(ids)::INTEGER AS schema_count,
            '{{"name":"' || name || '","version":' || version || ',"schema_cids":["' || array_to_string(ids, '","') || '"]}}' AS canonical FROM d""",
        "domain_bridges": f"WITH {MAPPINGS}, {MEMBERS} SELECT s.domain AS source_domain, t.domain AS target_domain, count(*) AS mapping_count, count(DISTINCT source_field) AS source_coverage, count(DISTINCT target_field) AS target_coverage, round(avg(confidence), 9) AS avg_confidence FROM m JOIN mem s ON source_schema = s.schema_cid JOIN mem t ON target_schema = t.schema_cid GROUP BY 1, 2",
        "disagreements": f"WITH {MAPPINGS}, {GROUPS} SELECT {KEY}, competing, agent_count FROM g WHERE agent_count >= 2 AND (spread > 0.1::DOUBLE OR directions > 1)",
        "convergent_mappings": f"WITH {MAPPINGS}, {GROUPS} SELECT best.ord AS ord, {KEY}, best.confidence AS confidence, best.agent AS agent, best.direction AS direction FROM g WHERE agent_count >= 2 AND spread <= 0.1::DOUBLE AND directions = 1",
        "transitive_closure": CLOSURE,
    }
