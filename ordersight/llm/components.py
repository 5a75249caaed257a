"""Connected components of an edge table by alternating large-star and small-star steps.

Every round is a few joins and aggregates over the edges; the edges are written
to the shared folder after each round, so the plan stays short and no round is
lost with an executor.  Stars with a hot centre are pre-aggregated by partial
minima, and the join that sends the minimum back is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import written


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v long); component: the smallest node reachable."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = written(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # Large star: every larger neighbour of a node points to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
