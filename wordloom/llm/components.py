"""Connected components by alternating large-star and small-star steps on DataFrames.

Nothing but two numbers per round comes to the driver. A node with a third of all
edges is no single group: its least neighbour is an aggregate with partial sums, and the
join that hands it back may be split by the optimiser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b. Large: each node's greater neighbours are
    linked to the least of its neighbours and itself. Small: each node's smaller
    neighbours, and itself, are linked to the least of them."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): of every node of edges (a, b) the least node it is linked with.

    Null ends and loops are left out. The rounds grow with the logarithm of the longest
    chain; beyond the given number an error is raised rather than a wrong result given.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, last = cut(now), None
    for _ in range(rounds):
        if now.isEmpty():
            break
        now = cut(_star(_star(now, True), False))
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
