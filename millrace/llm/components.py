"""Connected components of an edge list, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import written


def _small_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _small_first(edges)
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame, label: str) -> DataFrame:
    """Return (node, root) for the nodes of ``edges`` (a, b: long); the root is the smallest node.

    Alternates the large-star and small-star steps until the edges no longer
    change. A node's neighbours are never gathered: each step aggregates a
    minimum per node (combined before the shuffle) and joins it back, a join
    whose hot keys adaptive execution splits. Each round is written to the
    shared folder. Loops and repeated edges do no harm; no edge gives no row.
    """
    now = written(_small_first(edges).distinct(), label)
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen["n"] == 0 or (seen["n"], seen["x"]) == mark:
            break
        mark = (seen["n"], seen["x"])
        now = written(_small_star(_large_star(now).distinct()).distinct(), label)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
