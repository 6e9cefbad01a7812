"""Paths through the graph of derived series: what a series is made of, level by level.

The search is a join of the frontier with the edges for each level; what a level has reached is written to the
shared folder, so the plan does not grow. Where there are no more focuses than candidates it goes back from each
focus, once for all candidates: the least path from a node begins with the least of its inputs that are
a step nearer. Pairs whose search may meet its bound on visited nodes, and pairs of more focuses, are searched from the candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.storage import stored

# Bounds of the search.
MAX_DEPTH, MAX_VISITED, MAX_PATH = 10, 5000, 8


def dependency_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = MAX_DEPTH, max_visited: int = MAX_VISITED) -> DataFrame:
    """candidate, focus, depth, path (array) of those of ``pairs(candidate, focus)`` whose candidate is made of the
    focus, by ``edges(node, input)``.

    The path is the first that a breadth-first search with sorted inputs meets: of the shortest paths the least,
    element by element, over the first paths to each node. A pair's search stops after ``max_depth``
    edges, and enters no new node after ``max_visited``. Blank ids and pairs of equal ids have no path; cycles do
    no harm, since no node is entered twice.
    """
    some = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    links = stored(edges.select(some("node").alias("node"), some("input").alias("input")).dropna().distinct())
    asked = pairs.select(some("candidate").alias("candidate"), some("focus").alias("focus")).dropna().where("candidate <> focus").distinct()
    asked = stored(asked)
    candidates, focuses = asked.agg(F.count_distinct("candidate"), F.count_distinct("focus")).first()
    if focuses > candidates:
        return _forward(links, asked, max_depth, max_visited)
    wide = _wide(links, max_depth, max_visited).select(F.col("node").alias("candidate"))
    bounded = stored(asked.join(wide, "candidate", "left_semi"))
    if bounded.isEmpty():
        return _back(links, asked, max_depth)
    return _back(links, asked.join(wide, "candidate", "left_anti"), max_depth).unionByName(_forward(links, bounded, max_depth, max_visited))


def _wide(links: DataFrame, max_depth: int, max_visited: int) -> DataFrame:
    """The nodes from which a search may meet ``max_visited`` before its last level, by the number of walks (no fewer than the nodes they enter)."""
    most = F.lit(max_visited).cast("long")
    walks = stored(links.groupBy("node").agg(F.least(F.count("*"), most).alias("n")))
    every = walks.limit(0) if max_depth < 2 else walks
    for _ in range(max_depth - 2):
        ahead = links.join(walks.select(F.col("node").alias("input"), "n"), "input")
        walks = stored(ahead.groupBy("node").agg(F.least(F.sum("n"), most).alias("n")))
        every = every.unionByName(walks)
    return stored(every.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= most).select("node"))


def _back(links: DataFrame, asked: DataFrame, max_depth: int) -> DataFrame:
    """candidate, focus, depth, path by a search from each focus that enters every node."""
    key = ["focus", "node"]
    level = stored(asked.select("focus").distinct().select("focus", F.col("focus").alias("node"), F.array("focus").alias("path")))
    reached = level
    for _ in range(max_depth):
        behind = links.join(level.select("focus", F.col("node").alias("input"), "path"), "input").groupBy(*key).agg(F.min("path").alias("path"))
        level = stored(behind.join(reached.select(*key), key, "left_anti").select(*key, F.concat(F.array("node"), "path").alias("path")))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return asked.join(reached.withColumnRenamed("node", "candidate"), ["candidate", "focus"]).select("candidate", "focus", (F.size("path") - 1).alias("depth"), "path")


def _forward(links: DataFrame, asked: DataFrame, max_depth: int, max_visited: int) -> DataFrame:
    """The same by a search from each candidate, for each of its focuses."""
    front = stored(asked.select("candidate", "focus", F.col("candidate").alias("node"), F.array("candidate").alias("path")))
    key, seen, found = ["candidate", "focus"], front.select("candidate", "focus", "node"), None
    for _ in range(max_depth):
        ahead = front.join(links, "node").select(*key, F.col("input").alias("node"), F.concat("path", F.array("input")).alias("path"))
        # The least path to a node is its first one, so partial aggregation keeps one row for each.
        met = stored(ahead.groupBy(*key, "node").agg(F.min("path").alias("path")))
        hits = met.where("node = focus").select(*key, "path")
        found = hits if found is None else found.unionByName(hits)
        fresh = met.join(hits.select(*key), key, "left_anti").join(seen, [*key, "node"], "left_anti")
        entered = seen.groupBy(*key).agg(F.count("*").alias("entered"))
        order = Window.partitionBy(*key).orderBy("path")  # of one level of one pair
        within = fresh.withColumn("k", F.row_number().over(order)).join(entered, key).where(F.col("k") + F.col("entered") <= max_visited)
        front = stored(within.select(*key, "node", "path"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select(*key, "node"))
    if found is None:
        return asked.select(*key, F.lit(0).alias("depth"), F.array("candidate").alias("path")).limit(0)
    return found.select(*key, (F.size("path") - 1).alias("depth"), "path")


def shortened(path: str = "path", most: int = MAX_PATH):
    """A path of at most ``most`` nodes: its beginning, and the focus at its end."""
    p = F.col(path)
    return F.when(F.size(p) <= most, p).otherwise(F.concat(F.slice(p, 1, most - 1), F.slice(p, -1, 1)))
