"""Connected components of an edge table, by alternating star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.session import new_folder, stored


def _star(edges: DataFrame, both_sides: bool) -> DataFrame:
    """Ties the neighbours of every node to the smallest of them and itself.

    The step over both sides moves larger neighbours only, the other one the smaller ones and the
    node.  Minima are written before they are joined back, so that a node with many edges can be
    split by adaptive execution.
    """
    spark = edges.sparkSession
    if both_sides:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    least = stored(least.withColumn("m", F.least("a", "m")), new_folder(spark, "least"))
    joined = edges.join(least, "a")
    if both_sides:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        ends = F.array(F.col("a"), F.col("b"))
        moved = joined.select(F.explode(ends).alias("a"), F.col("m").alias("b"))
    return stored(moved.where("a > b").distinct(), new_folder(spark, "stars"))


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node to the smallest of its component."""
    ends = edges.select(F.col("b").alias("a"))
    twice = edges.groupBy("a").count().where("count > 1")
    return edges.join(ends, "a", "left_semi").isEmpty() and twice.isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; a component is its smallest node.

    The number of rounds grows with the logarithm of the longest chain.  No table is collected.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.where("a > b").distinct(), new_folder(edges.sparkSession, "edges"))
    while not _settled(edges):
        edges = _star(_star(edges, True), False)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )
