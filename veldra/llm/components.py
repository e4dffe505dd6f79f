"""Connected components of a graph given as edges, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veldra.storage import stage

#: Rounds after which the loop gives up; each at least halves the longest chain.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of edges ``a, b``: the least node reachable from each node.

    Alternating large-star and small-star steps; every round is two aggregations by
    node and is written to the shared folder, so lost executors cost no earlier
    round. A node with very many neighbours is only ever aggregated (a minimum), its
    neighbours are never gathered. Loops and repeated edges are allowed; an empty
    graph gives an empty result. Nulls take no part.
    """
    now = stage(edges.select("a", "b").filter("a is not null and b is not null and a <> b").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        # Large star: each node's larger neighbours are tied to its least neighbour or itself.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: each node and its smaller neighbours are tied to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = stage(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
