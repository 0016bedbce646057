"""Distributed union-find with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.store import drop, saved


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node that has an edge.

    Every round points each node at the neighbour of lowest hash (or itself) and contracts the
    edges; hashed order makes the number of live nodes fall by a constant factor a round, on long
    chains too. Self-links, repeated and null edges are harmless: a null end drops the edge, a
    self-link gives a component of its own. All edges stay distributed; the driver learns only
    whether any are left.
    """
    live = saved(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    ends = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    nodes = saved(ends.withColumn("root", F.col("node")))
    live = live.where("a <> b")
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = saved(
            both.groupBy("a").agg(F.min(rank("b")).alias("best"))
            .select(F.col("a").alias("at"), F.least(F.col("best"), rank("a"))["id"].alias("to"))
        )
        moved = saved(
            nodes.join(hop, nodes["root"] == hop["at"], "left").select("node", F.coalesce("to", "root").alias("root"))
        )
        left = hop.select(F.col("at").alias("a"), F.col("to").alias("x"))
        right = hop.select(F.col("at").alias("b"), F.col("to").alias("y"))
        rest = saved(
            live.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        for old in (hop, nodes, live):
            drop(old)
        nodes, live = moved, rest
    return nodes
