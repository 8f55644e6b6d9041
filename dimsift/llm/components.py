"""Connected components of a graph given as edges, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``); a component is named by its smallest node.

    Every round links the larger neighbours of each node to its smallest one, then the smaller ones,
    until all that is left is a star around the smallest node. The rounds grow with the logarithm of
    the number of nodes. Every round is stored, so lost executors cost no more than one.
    """
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        large = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = large.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        linked = large.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        linked = linked.where("a <> b").distinct()
        small = linked.groupBy("a").agg(F.min("b").alias("least"))
        joined = linked.join(small, "a")
        state = materialize(
            joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(small.select("a", F.col("least").alias("b"))).distinct(),
            "edges",
        )
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    stars = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
