"""What mappings say across domains: bridges, disagreements of agents, convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .domains import membership
from .mappings import KEY

SPREAD = 0.1


def domain_bridges(mappings: DataFrame, domains: DataFrame) -> DataFrame:
    """(source_domain, target_domain, mapping_count, source_coverage, target_coverage, avg_confidence), by ordered pair.

    Mappings with an end in no domain are left out. Coverage counts distinct field names.
    """
    at = membership(domains)
    s = at.select(F.col("schema_cid").alias("source_schema"), F.col("domain").alias("source_domain"))
    t = at.select(F.col("schema_cid").alias("target_schema"), F.col("domain").alias("target_domain"))
    rows = mappings.join(s, "source_schema").join(t, "target_schema")
    return rows.groupBy("source_domain", "target_domain").agg(
        F.count(F.lit(1)).alias("mapping_count"), F.count_distinct("source_field").alias("source_coverage"),
        F.count_distinct("target_field").alias("target_coverage"), F.avg("confidence").alias("avg_confidence"),
    ).orderBy(F.desc("mapping_count"), "source_domain", "target_domain")


def key_groups(mappings: DataFrame) -> DataFrame:
    """One row for each key: competing mappings in the order of ord, agents, spread of confidences, directions, best.

    Disagreements and convergent mappings are complementary filters on it; cache it to use both.
    """
    m = F.struct("ord", *KEY, "confidence", "justification", "agent", "direction")
    checked = mappings.withColumn("confidence", F.when(F.isnan("confidence"), F.raise_error(F.lit("a confidence is not a number"))).otherwise(F.col("confidence")))
    return checked.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(m)).alias("competing"), F.count_distinct("agent").alias("agent_count"),
        (F.max("confidence") - F.min("confidence")).alias("spread"), F.count_distinct("direction").alias("directions"),
        F.max_by(m, F.struct("confidence", "ord")).alias("best"),
    )


def disagreements(mappings: DataFrame) -> DataFrame:
    """(key, competing, agent_count): two agents at least, and confidences that lie over SPREAD apart or directions that differ."""
    g = key_groups(mappings).where((F.col("agent_count") >= 2) & ((F.col("spread") > F.lit(SPREAD)) | (F.col("directions") > 1)))
    return g.select(*KEY, "competing", "agent_count").orderBy(F.desc("agent_count"), *KEY)


def convergent_mappings(mappings: DataFrame) -> DataFrame:
    """The mapping with the highest confidence (the last of equals) of each key on which two agents at least agree."""
    g = key_groups(mappings).where((F.col("agent_count") >= 2) & (F.col("spread") <= F.lit(SPREAD)) & (F.col("directions") == 1))
    return g.select("best.*").orderBy(F.desc("confidence"), *KEY)
