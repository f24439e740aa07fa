"""Connected components of a graph given as edge rows, by alternating star contractions.

Each round makes every node point to the smallest node it sees (large star), then
links the smaller neighbours among themselves (small star).  Rounds grow with the
logarithm of the longest path; no node list is gathered anywhere. Minima are taken in each
task first. They go back to the edges by a broadcast where the edges are counted to be few;
else only those of nodes with very many neighbours (HUB or more) do, and the rest is shuffled.
Rounds never add edges, so a round is read in tasks of TASK_EDGES of the edges counted before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, gathered, written


SMALL = 1_000_000  # edges whose nodes' minima are broadcast (16 bytes each)
TASK_EDGES = 50_000  # edges that a task reads at least, unless there are fewer tasks than cores
HUB = 10_000  # least neighbours of a node that isn't shuffled; at most edges / HUB nodes, 100,000 at most


def _beside(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows with the minimum m of their u; least: (u, m, n), n being the neighbours of u."""
    if edges <= SMALL:
        return rows.join(F.broadcast(least.drop("n")), "u")
    hubs = F.broadcast(least.where(F.col("n") >= max(HUB, edges // 50_000)).drop("n"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(least.drop("n"), "u")
    return rows.join(hubs, "u").unionByName(others)


def _counted(edges: DataFrame, about: int | None) -> tuple[int, bool]:
    """The number of distinct edges, and whether all are stars: no node has two smaller neighbours, or one that has one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = _few(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")), about)
    n, bent = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.col("up") + F.col("down") > 1)).first()
    return int(n), not bent


def _few(df: DataFrame, edges: int | None) -> DataFrame:
    return df if edges is None else gathered(df, edges, TASK_EDGES)


def components(edges: DataFrame, about: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Self-loops and repeated edges are fine, null ends are dropped; an empty input gives no rows.
    about: how many edges there are roughly, if that is known; it only says how many tasks take them.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    e = written(_few(e, about))
    n, stars = _counted(e, about)
    while not stars:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), n)
        large = _beside(both, least, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _few(large.where("u > v").distinct(), n)
        least = _few(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), n)
        small = _beside(large, least, n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, e = e, written(_few(small.where("u > v").distinct(), n))
        forget(before)
        n, stars = _counted(e, n)
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = _few(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(), n)
    return pairs.unionByName(roots)
