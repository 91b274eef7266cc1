"""Connected components of a link table by alternating star steps.

Each step links every node to the least neighbour it knows; the work of a step
is an aggregate (with partial minima before the shuffle) and an equi-join on
the node. The minima are written before the join, so that both its sides are
plain exchanges and adaptive execution splits a node with many links. Nothing
but two numbers a step reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the least node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the least of them (a > b in ``edges``)."""
    least = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("m")))
    return (edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``): the least node reachable from each node that has a
    link; ``edges`` has columns ``a`` and ``b``. Links to itself are ignored."""
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        now = cut_lineage(_small_star(_large_star(now)).distinct())
