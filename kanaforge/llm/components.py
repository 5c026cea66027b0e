"""Connected components of an edge table by alternating star contraction.

Every round is two joins with a per-node minimum (a partial aggregate), so no adjacency
list is ever gathered; AQE splits the join of a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = e.select(F.col("a").alias("n"), F.col("b").alias("w")).unionByName(
        e.select(F.col("b").alias("n"), F.col("a").alias("w")))
    low = both.groupBy("n").agg(F.min("w").alias("low")).select("n", F.least("n", "low").alias("low"))
    return both.join(low, "n").where("w > n AND w <> low").select(F.col("w").alias("a"), F.col("low").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (a > b on input)."""
    low = e.groupBy("a").agg(F.min("b").alias("low"))
    moved = e.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another one; root is the smallest
    node of its component. Null ends and self loops are ignored; an empty edge table gives
    an empty result."""
    # greatest and least skip nulls, so an edge with a null end becomes a self loop.
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = materialize(e)
    state = None
    for _ in range(max_rounds):
        e = materialize(_small_star(_large_star(e).distinct()))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
