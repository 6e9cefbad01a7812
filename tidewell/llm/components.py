"""Connected components of an edge table, by alternating star steps.

A large-star step joins each node's larger neighbours to its smallest neighbour, a small-star
step its smaller ones; when nothing changes, every node has one edge, to the smallest id of its
component. Each turn is a few shuffles of the edges and is written to the shared folder, so lost
executors cost no more than a turn; nothing is gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize


def connected_components(edges: DataFrame, max_turns: int = 50) -> DataFrame:
    """(id, component) of the nodes of ``edges(a, b)`` that are not the smallest of theirs.

    Edges may be repeated and point either way; loops and edges with a null end count for nothing.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    before = None
    for _ in range(max_turns):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join below reads plain shuffles, which adaptive execution splits at busy nodes.
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = now.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lower, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(moved.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if before is not None and tuple(state) == before:
            break
        before = tuple(state)
        if not state[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_turns} turns")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
