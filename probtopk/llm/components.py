"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def _least(around: DataFrame) -> DataFrame:
    """(u, w, n) written: the least neighbour of each node and how many it has.

    It is a table of its own so that joining it back never gathers the neighbours
    of one node: either it is broadcast, or Spark can split a node with very many.
    """
    return common.materialize(around.groupBy("u").agg(F.min("v").alias("w"), F.count(F.lit(1)).alias("n")), "least")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least id reachable, for every node of edges (a, b); an empty table has no nodes.

    Alternates large-star (larger neighbours are joined to the least node around)
    and small-star (smaller ones), which halve the distances to the least node;
    each step is written to the shared folder. It ends when every node with a smaller neighbour has no other.
    """
    now = common.materialize(_distinct_edges(edges), "edges")
    for _ in range(0 if now.isEmpty() else MAX_ROUNDS):
        around = _both_ways(now)
        least = _least(around)
        if least.where("w < u AND n > 1").isEmpty():
            break
        large = common.lookup(around, least, "u").where("v > u").select(F.col("v").alias("a"), F.least("u", "w").alias("b"))
        now = common.materialize(_distinct_edges(large), "stars")
        around = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = _least(around)
        small = common.lookup(around, least, "u").select(F.col("v").alias("a"), F.col("w").alias("b"))
        now = common.materialize(_distinct_edges(small.unionByName(least.select(F.col("u").alias("a"), F.col("w").alias("b")))), "stars")
    else:
        if not now.isEmpty():
            raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
