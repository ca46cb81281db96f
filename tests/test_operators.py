"""Topology, mappings, alignment, bridges and closure."""

import json
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from claimgraph.functions.kinds import CID, FLOAT, INTEGER, STRING, BOOL, list_of, ref
from claimgraph.functions.schema import Schema
from claimgraph.operators import align as al
from claimgraph.operators import bridge, domains, mappings
from claimgraph.operators.closure import transitive_closure
from claimgraph.operators.topology import NODES, Topology
from conftest import rows


def nodes(spark, *items):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(items)], NODES)


def test_convergence(spark):
    t = Topology(nodes(spark, ("aaa", "schema1", "id1", "claude", []), ("bbb", "schema1", "id1", "codex", []), ("ccc", "schema1", "id2", "claude", [])))
    assert [tuple(r) for r in t.clusters().collect()] == [("schema1", "id1", ["aaa", "bbb"], 2, 2), ("schema1", "id2", ["ccc"], 1, 1)]
    assert [r["identity_hash"] for r in t.convergent_clusters().collect()] == ["id1"]
    assert t.schema_count().first()[0] == 1 and t.cluster_count().first()[0] == 2
    assert rows(t.cluster_sizes()) == [(1, 1), (2, 1)]
    assert rows(t.dedup_stats()) == [("schema1", 3, 3, 2, 1.5)]
    assert [(r["identity_hash"], r["node_cid"]) for r in t.latest_by_identity().orderBy("identity_hash").collect()] == [("id1", "bbb"), ("id2", "ccc")]


def test_co_occurrence_counts_every_ancestor(spark):
    t = Topology(nodes(spark, ("aaa", "observation", "id1", "a", ["claim"]), ("bbb", "observation", None, "a", ["claim", "claim", "observation"]), ("ccc", "claim", "id", "a", ["observation"]), ("ddd", None, "id", "a", ["claim"])))
    assert rows(t.co_occurrences()) == [("claim", "observation", 4)]


def test_shared_cids_count_agents_wherever_they_occur(spark):
    df = nodes(spark, ("x", "s", "i", "a", []), ("x", None, None, "b", []), ("x", "s", "j", "c", []), ("y", "s", "i", "a", []))
    got = {r["identity_hash"]: (r["node_cids"], r["agent_count"]) for r in Topology(df).clusters().collect()}
    assert got == {"i": (["x", "y"], 3), "j": (["x"], 3)}
    unique = {r["identity_hash"]: r["agent_count"] for r in Topology(df, cids_unique=True, with_members=False).clusters().collect()}
    assert unique == {"i": 1, "j": 1}


def test_topology_against_loops(spark):
    r = random.Random(3)
    pick = lambda xs: r.choice(xs)
    items = [(f"n{r.randint(0, 8)}", pick(["s", "t", None]), pick(["i", "j", "", None]), pick("abc"), [pick("stu") for _ in range(r.randint(0, 3))]) for _ in range(60)]
    clusters = defaultdict(list)
    pairs = defaultdict(int)
    for cid_, s, i, _, anc in items:
        if s is not None and i is not None:
            clusters[s, i].append(cid_)
        if s is not None:
            for a in anc:
                if a != s:
                    pairs[min(a, s), max(a, s)] += 1
    expected = sorted((s, i, c, len(c), len({x[3] for x in items if x[0] in c})) for (s, i), c in clusters.items())
    t = Topology(nodes(spark, *items))
    assert sorted(tuple(x) for x in t.clusters().collect()) == expected
    assert {(a, b): n for a, b, n in rows(t.co_occurrences())} == dict(pairs)


def test_empty_topology(spark):
    t = Topology(spark.createDataFrame([], NODES))
    assert t.clusters().count() == t.co_occurrences().count() == t.convergent_clusters().count() == 0
    assert t.cluster_count().first()[0] == 0


def table(spark, *items):
    """(source, target, confidence, agent, direction) with ends as "schema.field"."""
    return spark.createDataFrame([(i, *s.split("."), *t.split("."), c, "", a, d) for i, (s, t, c, a, d) in enumerate(items)], mappings.TABLE)


def test_normalise(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", "d", None, None, None, None), (2, "a", "b", "c", "d", 2.0, "j", "x", "reverse"), (3, "a", "b", "c", "d", float("nan"), "j", "x", "reverse")], mappings.TABLE)
    got = mappings.normalise(df).orderBy("ord").collect()
    assert [(r["confidence"], r["justification"], r["agent"], r["direction"]) for r in got[:2]] == [(0.5, "", "unknown", "forward"), (1.0, "j", "x", "reverse")]
    assert got[2]["confidence"] != got[2]["confidence"]
    with pytest.raises(Exception, match="no such direction"):
        mappings.normalise(table(spark, ("a.b", "c.d", 0.5, "a", "up"))).collect()


def test_mapping_json(spark):
    base = {"source_schema": "a", "source_field": "b", "target_schema": "c", "target_field": "d", "confidence": 1, "justification": "", "agent": "x", "direction": "forward"}
    without = lambda k, **more: json.dumps({n: v for n, v in base.items() if n != k} | more)
    texts = [
        json.dumps(base), without("", confidence=7.5, extra=1), without("direction", confidence="x"), without("", direction="up", confidence="x"), without("confidence", source_schema=1),
        without("source_schema", agent=1), without("agent", justification=1), "[]", "{", "null",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    got = mappings.from_json(df, "j").orderBy("i").collect()
    assert got[0]["error"] is None and got[0]["confidence"] == 1.0
    assert got[1]["error"] is None and got[1]["confidence"] == 7.5
    assert [(r["error"]["code"], r["error"]["field"]) for r in got[2:]] == [
        ("missing_field", "direction"), ("type_mismatch", "direction"), ("missing_field", "confidence"), ("missing_field", "source_schema"), ("missing_field", "justification"),
        ("type_mismatch", "<root>"), ("serde", None), ("type_mismatch", "<root>"),
    ]


def test_reversed(spark):
    df = table(spark, ("alpha.a", "beta.b", 0.7, "x", "forward"), ("alpha.a", "beta.b", 0.7, "x", "bidirectional"))
    got = mappings.reversed_mappings(df).orderBy("ord").collect()
    assert [(r["source_schema"], r["target_field"], r["direction"]) for r in got] == [("beta", "a", "reverse"), ("beta", "a", "bidirectional")]
    assert rows(mappings.reversed_mappings(mappings.reversed_mappings(df))) == rows(df)
    assert rows(mappings.by_key(df)) == [("alpha", "a", "beta", "b", 2)]


def similarity(a: str, b: str) -> float:
    x, y = a.lower().encode(), b.lower().encode()
    if not x or not y:
        return float(x == y)
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(1.0, 1 - row[-1] / max(len(x), len(y)) + (0.3 if x in y or y in x else 0.0))


def test_names(spark):
    r = random.Random(8)
    names = ["patient_id", "patient_identifier", "name", "address", "id", "identifier", "", "é", "e", "ÉCOLE", "école", *("".join(r.choice("abé_") for _ in range(r.randint(1, 6))) for _ in range(20))]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for a, b, s in df.select("a", "b", al.name_similarity(F.col("a"), F.col("b"))).collect():
        assert s == pytest.approx(similarity(a, b), abs=1e-12), (a, b)
    assert similarity("patient_id", "patient_identifier") == pytest.approx(0.8556, abs=1e-4)


def test_kinds(spark):
    kinds = [STRING, INTEGER, FLOAT, BOOL, CID, ref("a"), ref("b"), list_of(INTEGER), list_of(FLOAT), list_of(list_of(INTEGER)), list_of(list_of(FLOAT)), list_of(ref("a")), list_of(CID), ref('{"list":')]
    df = spark.createDataFrame([(a.text(), b.text(), al.type_compatibility(a, b)) for a in kinds for b in kinds], "a string, b string, s double")
    assert [tuple(r) for r in df.withColumn("t", al.type_score(F.col("a"), F.col("b"))).where("s <> t").collect()] == []
    expected = [((STRING, STRING), 1.0), ((INTEGER, FLOAT), 0.5), ((STRING, BOOL), 0.0), ((list_of(INTEGER), list_of(FLOAT)), 0.5), ((STRING, CID), 0.5), ((ref("a"), ref("b")), 0.0), ((ref("a"), CID), 0.3), ((ref("a"), STRING), 0.0)]
    assert all(al.type_compatibility(*p) == s == al.type_compatibility(*p[::-1]) for p, s in expected)


def test_align(spark):
    medical = Schema("medical", 1).identity("patient_id", STRING).required("diagnosis", STRING).required("date", STRING)
    insurance = Schema("insurance", 1).identity("member_id", STRING).required("condition", STRING).required("claim_date", STRING)
    got = {(r["source_field"], r["target_field"]): r for r in al.align(al.fields_of(spark, medical), al.fields_of(spark, insurance)).collect()}
    assert got["date", "claim_date"]["confidence"] == pytest.approx(0.88)
    assert got["patient_id", "member_id"]["rationale"]["name_score"] < 0.5
    own = al.align(al.fields_of(spark, medical), al.fields_of(spark, medical)).collect()
    assert own[0]["confidence"] == 1.0 and [r["confidence"] for r in own] == sorted((r["confidence"] for r in own), reverse=True)
    a = Schema("a", 1).required("foo", STRING).required("bar", INTEGER)
    b = Schema("b", 1).required("baz", BOOL).required("qux", FLOAT)
    high = al.align(al.fields_of(spark, a), al.fields_of(spark, b), al.AlignConfig(min_confidence=0.9))
    assert high.count() == 0


def test_candidates_become_mappings(spark):
    df = spark.createDataFrame([("s", "src_a", "t", "tgt_a", 1.5, (0.7, 1.0, 0.125))], "source_schema string, source_field string, target_schema string, target_field string, confidence double, rationale struct<name_score: double, type_score: double, identity_score: double>")
    m = al.candidates_to_mappings(df, "me").first()
    assert m["confidence"] == 1.0 and m["agent"] == "me" and m["direction"] == "forward"
    assert all(x in m["justification"] for x in ("name=0.70", "type=1.00", "identity=0.12"))


def test_bridges(spark):
    m = table(spark, ("p1.mass", "m1.value", 0.9, "a", "forward"), ("p1.velocity", "m1.rate", 0.8, "a", "forward"), ("p2.charge", "m1.quantity", 0.7, "b", "reverse"), ("p1.mass", "p2.mass", 0.5, "a", "forward"), ("p1.mass", "nowhere.x", 0.5, "a", "forward"), ("both.x", "m1.value", 1.0, "a", "forward"))
    d = spark.createDataFrame([(1, "physics", 1, ["p1", "p2", "both"]), (2, "math", 1, ["m1", "both"])], domains.TABLE)
    got = {(r[0], r[1]): tuple(r)[2:] for r in bridge.domain_bridges(m, d).collect()}
    assert got["physics", "math"][:3] == (3, 3, 3) and got["physics", "math"][3] == pytest.approx(0.8)
    assert got["physics", "physics"][0] == 1  # a domain may bridge to itself
    assert got["math", "math"][:3] == (1, 1, 1)  # of overlapping domains the last counts
    assert len(got) == 3


def test_disagreement_and_convergence(spark):
    m = table(
        spark, ("s1.x", "s2.y", 0.9, "claude", "forward"), ("s1.x", "s2.y", 0.5, "codex", "forward"), ("s1.a", "s2.b", 0.85, "claude", "forward"), ("s1.a", "s2.b", 0.90, "codex", "forward"),
        ("s1.c", "s2.c", 0.8, "a", "forward"), ("s1.c", "s2.c", 0.8, "b", "reverse"), ("s1.d", "s2.d", 0.8, "a", "forward"), ("s1.d", "s2.d", 0.1, "a", "forward"),
        ("s1.e", "s2.e", 0.7, "a", "forward"), ("s1.e", "s2.e", 0.8, "b", "forward"), ("s1.f", "s2.f", 0.8, "a", "forward"), ("s1.f", "s2.f", 0.9, "b", "forward"),
        ("s1.g", "s2.g", 0.9, "a", "forward"), ("s1.g", "s2.g", 0.5, "a", "forward"), ("s1.g", "s2.g", 0.9, "b", "forward"), ("s1.h", "s2.h", 0.4, "a", "forward"), ("s1.h", "s2.h", 0.4, "b", "forward"),
    )
    bad = {r["source_field"]: r for r in bridge.disagreements(m).collect()}
    assert set(bad) == {"x", "c", "e", "g"}  # 0.8 - 0.7 is a little over 0.1, 0.9 - 0.8 isn't
    assert [c["confidence"] for c in bad["g"]["competing"]] == [0.9, 0.5, 0.9]
    good = {r["source_field"]: r for r in bridge.convergent_mappings(m).collect()}
    assert set(good) == {"a", "f", "h"} and good["a"]["confidence"] == 0.9
    assert good["h"]["agent"] == "b"  # the last of equals


def test_nan_is_refused(spark):
    m = table(spark, ("s1.x", "s2.y", float("nan"), "a", "forward"), ("s1.x", "s2.y", 0.5, "b", "forward"))
    with pytest.raises(Exception, match="not a number"):
        bridge.disagreements(m).collect()


def walk(items, start, most):
    """Breadth first over keys in order: the same as the reference rule, one position after the other."""
    keys = defaultdict(list)
    for s, t, c, _, d in items:
        keys[(*s.split("."), *t.split("."))].append((c, d))
    edges = []
    for k in sorted(keys):
        edges.append((k[:2], k[2:], keys[k][0][0]))
        back = [c for c, d in keys[k] if d != "forward"]
        if back:
            edges.append((k[2:], k[:2], back[0]))
    start, found, seen = tuple(start.split(".")), {}, {tuple(start.split("."))}
    queue = deque([(start, (start,), 1.0)])
    while queue:
        at, path, c = queue.popleft()
        if len(path) > most:
            continue
        for a, b, w in edges:
            if a == at and b not in seen:
                seen.add(b)
                found[b] = (path + (b,), c * w)
                queue.append((b, path + (b,), c * w))
    return found


def closure(df, start, most):
    return {(r["schema"], r["field"]): (tuple(tuple(s) for s in r["steps"]), r["confidence"]) for r in transitive_closure(df, *start.split("."), most).collect()}


def test_closure(spark):
    items = [("sa.x", "sb.y", 0.9, "a", "forward"), ("sb.y", "sc.z", 0.8, "a", "forward")]
    two = closure(table(spark, *items), "sa.x", 3)
    assert two["sb", "y"][1] == 0.9 and two["sc", "z"][1] == pytest.approx(0.72) and len(two["sc", "z"][0]) == 3
    assert set(closure(table(spark, *items), "sa.x", 1)) == {("sb", "y")}
    assert closure(table(spark, *items), "sa.x", 0) == {} and closure(table(spark, *items), "no.where", 3) == {}
    assert len(closure(table(spark, ("sa.x", "sb.y", 0.9, "a", "bidirectional")), "sa.x", 10)) == 1
    assert set(closure(table(spark, ("sa.x", "sb.y", 0.9, "a", "reverse")), "sb.y", 2)) == {("sa", "x")}
    assert closure(table(spark, ("sa.x", "sb.y", 0.9, "a", "forward")), "sb.y", 2) == {}


@pytest.mark.parametrize("seed", range(4))
def test_closure_against_a_queue(spark, seed):
    r = random.Random(seed)
    spots = [f"s{i % 3}.f{i}" for i in range(9)]
    items = [(r.choice(spots), r.choice(spots), r.randint(1, 10) / 10, "a", r.choice(mappings.DIRECTIONS)) for _ in range(16)]
    got, expected = closure(table(spark, *items), spots[0], 4), walk(items, spots[0], 4)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(v[1] == pytest.approx(expected[k][1]) for k, v in got.items())
