"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"),
                                                           F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hops = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (hops.unionByName(least.select("u", F.col("m").alias("v")))
            .where("u != v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links to ``(node, root)``: root is the component's smallest
    node. Nodes without a link have no row; roots have one.

    Each round writes its edges to the checkpoint folder, so a lost executor
    costs a round at most, and the number of edges never grows.
    """
    edges = materialize(edges.select("u", "v").where("u != v").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        edges = materialize(_small_star(_large_star(edges)), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
