"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

ROUNDS = 2  # between two writes


def connected_components(links: DataFrame, left: str, right: str, name: str = "components") -> DataFrame:
    """Return ``node, component_id`` for all nodes that occur in ``links``.

    ``component_id`` is the smallest node that is reachable.  Each round runs a
    large-star and a small-star step: every node hands its neighbours to the
    smallest of them.  A step is one shuffle by node, in whose order the smallest
    neighbour comes first and repeated edges lie side by side.  What a round
    repeats is dropped by a shuffle of whole edges, so that no more than a hub's
    distinct edges meet in one task, sorted and spilled.  The rounds end when each
    node has one edge, to a node without one of its own, after about log2(n) of
    them; every ``ROUNDS`` of them the edges are written to the shared folder.  Links from a
    node to itself and repeated ones don't matter; nulls are ignored.  ``links``
    is read twice and should be a written table.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    pairs = links.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges, within = pairs.where("u <> v").distinct(), 1
    while within:
        for _ in range(ROUNDS):
            edges = _small_star(_large_star(edges)).distinct()
        edges = materialize(edges, name)
        ends = _either(edges, F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))
        within = ends.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").count()
    return ends.unionByName(pairs.where("u = v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component_id"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, linked to the smallest of it and its neighbours."""
    both = _either(edges, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return _neighbours(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours, all smaller, linked to the smallest of them."""
    return _neighbours(edges).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _neighbours(edges: DataFrame) -> DataFrame:
    """``u, v, m``: the distinct edges with the smallest neighbour of ``u``."""
    order = Window.partitionBy("u").orderBy("v")
    seen = edges.select("u", "v", F.first("v").over(order).alias("m"), F.lag("v").over(order).alias("before"))
    return seen.where("before is null or before < v").select("u", "v", "m")


def _either(edges: DataFrame, *rows: Column) -> DataFrame:
    return edges.select(F.explode(F.array(*rows)).alias("e")).select("e.u", "e.v")
