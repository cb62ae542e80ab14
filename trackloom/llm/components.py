"""Connected components of an edge table, without links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackloom.llm.scratch import stored


def _towards_least(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on edges (a, b): neighbours of a node move to the least of its neighbourhood.

    larger: each node sends its larger neighbours; else it sends itself and its
    smaller ones.  The least is a partial aggregate, stored so that the join
    back exchanges both sides and a hot node's rows can be split.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("least")), "least")
    near = both.join(least, F.col("a") == F.col("node"))
    if larger:
        moved = near.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = near.select("a", "b", "least").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return stored(moved.where("a <> b").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of the component of every node that has an edge (a, b).

    Alternates steps on larger and on smaller neighbours until nothing moves;
    the rounds grow with the logarithm of the longest path.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = _towards_least(_towards_least(edges, True), False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
