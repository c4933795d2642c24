"""Connected components by alternating large-star and small-star rounds over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.scratch import drop, saved


def _relink(edges: DataFrame, large: bool) -> DataFrame:
    """One star round: every neighbour v of u is linked to the smallest id among u and its neighbours."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        out = around.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # a > b holds for every edge, so a's smaller neighbours are its b
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b) with long ids; component is the smallest id reachable.

    Each round is a grouping and a join on node ids, written to the shared folder; a node with very many neighbours
    is pre-aggregated for its minimum and its join is a plain one that skew handling can split. The number of rounds
    grows with the logarithm of the longest path. Self-links and repeated edges do no harm; null ids are dropped.
    """
    now = saved(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # done when all links are stars: every node has one smaller neighbour, and that one has none
        high = now.groupBy("a").count()
        if high.where("count > 1").isEmpty() and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        large = saved(_relink(now, True), "edges")
        small = saved(_relink(large, False), "edges")
        drop(now, large)
        now = small
    out = saved(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct()), "components")
    drop(now)
    return out
