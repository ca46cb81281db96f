"""Candidate mappings between the fields of two schemas, by name, type and identity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import Kind
from .mappings import clamped
from ..functions.schema import Schema

FIELDS = "schema_cid string, ord int, name string, kind string, required boolean, identity boolean"


@dataclass(frozen=True)
class AlignConfig:
    """Weights needn't add up to 1."""

    min_confidence: float = 0.3
    name_weight: float = 0.4
    type_weight: float = 0.4
    identity_weight: float = 0.2


def fields_of(spark: SparkSession, schema: Schema) -> DataFrame:
    """The fields of one schema, in one partition: the pairs of two schemas are then one task."""
    cid = schema.cid()
    return spark.createDataFrame([(cid, i, f.name, f.kind.text(), f.required, f.identity) for i, f in enumerate(schema.fields)], FIELDS).coalesce(1)


def name_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance of the bytes in lower case over the longer one's bytes, plus 0.3 if one contains the other; 1 at most."""
    a, b = F.lower(a), F.lower(b)
    as_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    base = F.lit(1.0) - F.levenshtein(as_bytes(a), as_bytes(b)) / longest
    bonus = F.when(a.contains(b) | b.contains(a), F.lit(0.3)).otherwise(F.lit(0.0))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.least(base + bonus, F.lit(1.0)))


def type_compatibility(a: Kind, b: Kind) -> float:
    """Equal kinds 1; integer and float, string and content id 0.5; reference and content id 0.3; lists by their items; else 0."""
    if a == b:
        return 1.0
    names = {a.name, b.name}
    if names == {"list"}:
        return type_compatibility(a.inner, b.inner)
    if names in ({"integer", "float"}, {"string", "cid"}):
        return 0.5
    return 0.3 if names == {"ref", "cid"} else 0.0


def type_score(a: Column, b: Column) -> Column:
    """type_compatibility for kinds as JSON text: equal list depths are taken off first."""
    depth = lambda c: (F.length(c) - F.length(F.replace(c, F.lit('{"list":'), F.lit("")))) / 8
    both = F.least(F.when(a.startswith('{"list":'), F.length(F.regexp_extract(a, r'^((?:\{"list":)*)', 1)) / 8).otherwise(0), F.when(b.startswith('{"list":'), F.length(F.regexp_extract(b, r'^((?:\{"list":)*)', 1)) / 8).otherwise(0)).cast("int")
    strip = lambda c: F.substring(c, both * 8 + 1, F.length(c) - both * 9)
    x, y = strip(a), strip(b)
    pair = lambda p, q: ((x == p) & (y == q)) | ((x == q) & (y == p))
    is_ref = lambda c: c.startswith('{"ref":')
    return (
        F.when(a == b, F.lit(1.0)).when(pair('"integer"', '"float"') | pair('"string"', '"cid"'), F.lit(0.5))
        .when((is_ref(x) & (y == '"cid"')) | (is_ref(y) & (x == '"cid"')), F.lit(0.3)).otherwise(F.lit(0.0))
    )


def align(source: DataFrame, target: DataFrame, config: AlignConfig = AlignConfig()) -> DataFrame:
    """Every pair of a source and a target field (tables as fields_of makes them) whose score reaches the minimum.

    (source_schema, source_ord, source_field, target_schema, target_ord, target_field, confidence, rationale), best
    first, then in field order. The pairs are all compared: there is no key to join on, and schemas are small.
    """
    s = source.select(F.col("schema_cid").alias("source_schema"), F.col("ord").alias("source_ord"), F.col("name").alias("source_field"), F.col("kind").alias("sk"), F.col("identity").alias("si"))
    t = target.select(F.col("schema_cid").alias("target_schema"), F.col("ord").alias("target_ord"), F.col("name").alias("target_field"), F.col("kind").alias("tk"), F.col("identity").alias("ti"))
    scored = s.crossJoin(t).withColumn("rationale", F.struct(
        name_similarity(F.col("source_field"), F.col("target_field")).alias("name_score"),
        type_score(F.col("sk"), F.col("tk")).alias("type_score"),
        F.when(F.col("si") == F.col("ti"), F.lit(1.0)).otherwise(F.lit(0.3)).alias("identity_score"),
    ))
    r = lambda n: F.col(f"rationale.{n}_score")
    c = F.lit(config.name_weight) * r("name") + F.lit(config.type_weight) * r("type") + F.lit(config.identity_weight) * r("identity")
    rows = scored.withColumn("confidence", c).where(F.col("confidence") >= F.lit(config.min_confidence))
    return rows.select("source_schema", "source_ord", "source_field", "target_schema", "target_ord", "target_field", "confidence", "rationale").orderBy(F.desc("confidence"), "source_schema", "target_schema", "source_ord", "target_ord")


def candidates_to_mappings(candidates: DataFrame, agent: str) -> DataFrame:
    """Forward mappings with clamped confidence; the justification tells the three scores with two decimals."""
    two = lambda n: F.format_number(f"rationale.{n}_score", 2)
    why = F.concat(F.lit("structural alignment: name="), two("name"), F.lit(", type="), two("type"), F.lit(", identity="), two("identity"))
    return candidates.select(
        "source_schema", "source_field", "target_schema", "target_field", clamped(F.col("confidence")).alias("confidence"),
        why.alias("justification"), F.lit(agent).alias("agent"), F.lit("forward").alias("direction"),
    )
