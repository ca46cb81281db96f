"""Fields that mappings lead to within a number of hops, one shortest path each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, tables
from .mappings import KEY

STEP = "struct<schema: string, field: string>"


def edges_of(mappings: DataFrame) -> DataFrame:
    """(a, b, confidence, key): both ways along each key.

    Forward the key's first mapping counts, whatever its direction; backward the first that isn't "forward".
    """
    key = F.struct(*KEY)
    g = mappings.groupBy(*KEY).agg(
        F.min_by("confidence", "ord").alias("there"),
        F.min_by("confidence", F.when(F.col("direction") != "forward", F.col("ord"))).alias("back"),
        F.max((F.col("direction") != "forward").cast("int")).alias("both"),
    )
    end = lambda p: F.struct(F.col(f"{p}_schema").alias("schema"), F.col(f"{p}_field").alias("field"))
    there = g.select(end("source").alias("a"), end("target").alias("b"), F.col("there").alias("step"), key.alias("key"), F.lit(0).alias("turn"))
    back = g.where("both = 1").select(end("target").alias("a"), end("source").alias("b"), F.col("back").alias("step"), key.alias("key"), F.lit(1).alias("turn"))
    return there.unionByName(back)


def transitive_closure(mappings: DataFrame, schema: str, field: str, max_hops: int) -> DataFrame:
    """(schema, field, steps, hops, confidence): every other field within max_hops, by the first shortest path.

    Paths of a length are compared key by key. confidence is the product along the path. Best first, then by hops and
    path. A start that no mapping knows, or max_hops 0, gives no row.
    """
    spark = mappings.sparkSession
    with tables(spark) as keep:
        edges = cut(edges_of(mappings), "closure-edges")
        start = F.struct(F.lit(schema).alias("schema"), F.lit(field).alias("field"))
        frontier = spark.range(1).select(start.alias("node"), F.array(start).alias("steps"), F.lit(1.0).alias("confidence"), F.array().cast(f"array<{edges.schema['key'].dataType.simpleString()}>").alias("keys"))
        row = lambda f, hop: f.select(F.col("node.schema").alias("schema"), F.col("node.field").alias("field"), "steps", F.lit(hop).alias("hops"), "confidence", "keys")
        seen, found = frontier.select("node"), row(frontier, 0).limit(0)
        for hop in range(1, max_hops + 1):
            reached = frontier.join(edges, frontier["node"] == edges["a"]).select(
                F.col("b").alias("node"), F.concat("steps", F.array("b")).alias("steps"), (F.col("confidence") * F.col("step")).alias("confidence"), F.concat("keys", F.array("key")).alias("keys"), "turn")
            new = reached.join(seen, "node", "left_anti").groupBy("node").agg(F.min_by(F.struct("steps", "confidence", "keys"), F.struct("keys", "turn")).alias("p"))
            frontier = cut(new.select("node", "p.*"), "closure-frontier")
            if frontier.isEmpty():
                break
            found = found.unionByName(row(frontier, hop))
            seen = seen.unionByName(frontier.select("node"))
        found = keep(cut(found, "closure"))
    return found.orderBy(F.desc("confidence"), "hops", "keys").drop("keys")
