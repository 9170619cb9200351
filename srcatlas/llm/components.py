"""Connected components of an undirected graph by alternating large and small stars, over tables only.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every round is two aggregates and two equality
joins, written to the shared folder, so lost executors cost one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.session import durable


def _star(edges: DataFrame) -> DataFrame:
    """One large star, then one small star, of edges (``a`` > ``b``, distinct).

    The smallest neighbours are written, so that a hub's edges can be split where they are joined to them.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    large = durable(large, "large-star")
    floor = durable(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
    joined = large.join(floor, "a")
    small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b")))
    return small.distinct()


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them that changes with any edge: two numbers."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` (longs) -> ``node``, ``root``: each node that has an edge to another, with the smallest node it reaches.

    Loops and repeated edges do no harm; an empty table gives an empty table.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = durable(_star(now), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
