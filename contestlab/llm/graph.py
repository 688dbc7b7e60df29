"""Connected components over edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One half step. edges: u, v with u != v in any order.

    Large: every neighbour above u moves to the least of u's neighbourhood.
    Small: u and all its neighbours below it move to the least of them.
    The least is joined back instead of gathering neighbour lists, so a hub with any number of neighbours
    is pre-aggregated in the groupBy and can be split by the adaptive join.
    """
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    near = edges.select("u", "v").union(edges.select("v", "u"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node) for all nodes of edges (u, v; loops and repeats are ignored).

    Alternating large-star and small-star steps; the number of rounds grows with the logarithm of the
    longest path. Each round is written to the shared folder, so lineage stays short and a lost executor
    costs one round at most. An empty table gives an empty table.
    """
    now = materialize(edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        old, now = now, materialize(_stars(_stars(now, small=False), small=True), "stars")
        discard(old)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
