"""Connected components of an undirected graph by alternating large and small stars.

Every step is an aggregate with map-side combine and a join back, so a node with very
many neighbours is never gathered in one task. Each step's edges are written to the
shared folder, which cuts the lineage. Steps grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fewer_tasks, stored

#: Edges of a task, at least, where a step is written.
TASK_EDGES = 100_000


def _with_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v."""
    to = _with_least(edges)
    return to.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(to.select("u", F.col("m").alias("v"))).where("u != v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, at_most: int | None = None) -> DataFrame:
    """(u, v) edges -> (node, root) with the smallest node of the component as root, for all nodes of an edge.

    Null ends and loops are left out; without edges the result has no rows. ``at_most`` bounds
    the edges, if it is known; no step makes more of them, so the tasks that write go by it.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now, before = stored(now if at_most is None else fewer_tasks(now, at_most, TASK_EDGES), "edges"), None
    while (state := _state(now)) != before:
        before = state
        now = stored(fewer_tasks(_small_star(_large_star(now).distinct()).distinct(), state[0], TASK_EDGES), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
