"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _to_least(edges: DataFrame, keep: str) -> DataFrame:
    """Every edge end ``v`` of a node ``u`` is tied to the least node around
    ``u``.  A node's edges are never gathered: the least is an aggregate, and the
    join back may split a node with many edges."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).hint("rebalance")
    return edges.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (u, v) edges; a component is named
    after its least node.  Rounds, each of them cut by a checkpoint, double the
    reach, until nothing changes."""
    edges = durable(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, "v > u").distinct()
        # small star: each node's smaller neighbours, and the node itself, to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = durable(small.distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
