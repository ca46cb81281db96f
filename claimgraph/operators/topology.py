"""Clusters of nodes by schema and identity, agents that agree, schemas that occur together in lineage.

nodes: (ord BIGINT, node_cid, schema_cid, identity_hash, agent STRING, ancestor_schemas ARRAY<STRING>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODES = "ord long, node_cid string, schema_cid string, identity_hash string, agent string, ancestor_schemas array<string>"
KEY = ("schema_cid", "identity_hash")


class Topology:
    """Lazy views of a table of nodes.

    cids_unique: promise that no node_cid occurs on two rows; agents are then counted inside each group, without
    the join that otherwise counts every agent of a cluster's node_cids wherever they occur.
    with_members: also collect the node_cids of each cluster, in the order of ord.
    """

    def __init__(self, nodes: DataFrame, cids_unique: bool = False, with_members: bool = True):
        self.nodes, self.cids_unique, self.with_members = nodes, cids_unique, with_members

    @property
    def members(self) -> DataFrame:
        return self.nodes.where("schema_cid IS NOT NULL AND identity_hash IS NOT NULL")

    def _agents(self) -> DataFrame:
        """(key, agent_count) of each cluster."""
        if self.cids_unique:
            return self.members.groupBy(*KEY).agg(F.count_distinct("agent").alias("agent_count"))
        own = self.members.select(*KEY, "node_cid").distinct()
        return own.join(self.nodes.select("node_cid", "agent").distinct(), "node_cid").groupBy(*KEY).agg(F.count_distinct("agent").alias("agent_count"))

    def _clusters(self, least_agents: int = 0) -> DataFrame:
        """Agents are counted first, so that members of clusters with too few of them are never collected."""
        aggs = [F.count(F.lit(1)).alias("size")]
        if self.with_members:
            aggs.insert(0, F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_cid"))), lambda x: x["node_cid"]).alias("node_cids"))
        if self.cids_unique and not least_agents:
            return self.members.groupBy(*KEY).agg(*aggs, F.count_distinct("agent").alias("agent_count"))
        agents, members = self._agents(), self.members.select(*KEY, "ord", "node_cid")
        if least_agents:
            agents = agents.where(F.col("agent_count") >= least_agents)
            members = members.join(agents.select(*KEY), list(KEY), "left_semi")
        return members.groupBy(*KEY).agg(*aggs).join(agents, list(KEY))

    def clusters(self) -> DataFrame:
        """(schema_cid, identity_hash, [node_cids,] size, agent_count), largest first."""
        return self._clusters().orderBy(F.desc("size"), *KEY)

    def convergent_clusters(self) -> DataFrame:
        """Clusters with more than one agent."""
        return self._clusters(2).orderBy(F.desc("size"), *KEY)

    def co_occurrences(self) -> DataFrame:
        """(schema_a, schema_b, count): how often a node of one schema has an ancestor of the other, in either order."""
        rows = self.nodes.where("schema_cid IS NOT NULL").select("schema_cid", F.explode("ancestor_schemas").alias("other")).where("schema_cid <> other")
        pairs = rows.groupBy(F.least("schema_cid", "other").alias("schema_a"), F.greatest("schema_cid", "other").alias("schema_b"))
        return pairs.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "schema_a", "schema_b")

    def schema_count(self) -> DataFrame:
        """One row (schema_count): distinct schemas of clusters."""
        return self.members.agg(F.count_distinct("schema_cid").alias("schema_count"))

    def cluster_count(self) -> DataFrame:
        """One row (cluster_count)."""
        return self.members.agg(F.count_distinct(*KEY).alias("cluster_count"))

    def nodes_of_schema(self, schema_cid: str) -> DataFrame:
        return self.nodes.where(F.col("schema_cid") == schema_cid)

    def dedup_stats(self) -> DataFrame:
        """(schema_cid, nodes, distinct_cids, distinct_identities, ratio): how many nodes a stored identity stands for."""
        return self.members.groupBy("schema_cid").agg(
            F.count(F.lit(1)).alias("nodes"), F.count_distinct("node_cid").alias("distinct_cids"), F.count_distinct("identity_hash").alias("distinct_identities"),
        ).withColumn("ratio", F.col("nodes") / F.col("distinct_identities"))

    def latest_by_identity(self) -> DataFrame:
        """The node with the largest ord of each cluster: same identity, newest content."""
        return self.members.groupBy(*KEY).agg(F.max_by(F.struct("ord", "node_cid", "agent"), "ord").alias("n")).select(*KEY, "n.ord", "n.node_cid", "n.agent")

    def cluster_sizes(self) -> DataFrame:
        """(size, clusters): how many clusters have each size."""
        return self.members.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def lineage_nodes(df: DataFrame, group: str, order: str, schema: str, identity: str, agent: str, ord_column: str) -> DataFrame:
    """Nodes whose ancestors are the earlier rows of their group, each row's schema once for each such row."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        F.col(ord_column).alias("ord"), F.sha2(F.col(ord_column).cast("string"), 256).alias("node_cid"), F.col(schema).alias("schema_cid"),
        F.sha2(F.col(identity), 256).alias("identity_hash"), F.col(agent).cast("string").alias("agent"), F.collect_list(schema).over(w).alias("ancestor_schemas"),
    )
