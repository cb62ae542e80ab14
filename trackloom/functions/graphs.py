"""Graphs as edge tables: a minimum spanning forest by rounds, lineage cut after each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.sources import tables


def cut(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read again: computed once, in few files, so that rounds over small tables have few tasks."""
    return tables.held(df)


def _follow(parents: DataFrame) -> DataFrame:
    """(node, root) of (node, to) without cycles: each step doubles how far a node looks."""
    while True:
        ahead = parents.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = cut(parents.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        parents = moved.select("node", "to")
        if not moved.where("moved").head(1):
            return parents.withColumnRenamed("to", "root")


def spanning_forest(edges: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """The edges (a, b, and what else they hold) that join two components when taken one by one in an order, and (node, root).

    The order must differ between edges.  In each round every component picks
    its first edge to another (a partial aggregate, so a hot node is no hot
    task), which are all in the forest; picked components become one.  Rounds
    grow with the logarithm of the nodes, and so do the steps inside them.
    Edges of a node with itself are left out; no edge gives two empty tables.
    """
    edges = cut(edges.where("a <> b").withColumn("__o", order))
    live = edges.select("a", "b", "__o")
    nodes = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    picked = None
    while live.head(1):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "__o"))
        first = cut(both.groupBy("a").agg(F.min(F.struct("__o", "b")).alias("m")).select("a", F.col("m.b").alias("to"), F.col("m.__o").alias("__o")))
        picked = first.select("__o") if picked is None else picked.unionByName(first.select("__o"))
        # two that picked each other: the lesser stays where it is
        back = first.select(F.col("a").alias("to"), F.col("to").alias("back"))
        stays = F.col("back").eqNullSafe(F.col("a")) & (F.col("a") < F.col("to"))
        parents = first.join(back, "to", "left").select(F.col("a").alias("node"), F.when(stays, F.col("a")).otherwise(F.col("to")).alias("to"))
        roots = _follow(cut(parents))
        named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"__{c}"))
        nodes = cut(nodes.join(named("root"), "root", "left").select("node", F.coalesce("__root", "root").alias("root")))
        live = cut(live.join(named("a"), "a").join(named("b"), "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"), "__o").where("a <> b"))
    forest = edges.join(picked.distinct(), "__o", "left_semi") if picked is not None else edges
    return forest.drop("__o"), nodes
