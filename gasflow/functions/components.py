"""Connected components of an edge list (large-star and small-star rounds, Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gasflow.functions.sizing import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for edges ``a, b`` of integers; a component is named by its smallest node.

    Each step is written to the checkpoint folder. The number of rounds grows with the logarithm of
    the longest path.
    """
    current = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(current)
    while mark[0]:
        current = materialize(_small_star(materialize(_large_star(current))))
        following = _mark(current)
        if following == mark:
            break
        mark = following
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select("b", "b").distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two sums; equal marks mean an unchanged edge list."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def _with_least(neighbours: DataFrame) -> DataFrame:
    """Rows ``a, b`` with ``m``, the smallest ``b`` of their ``a``.

    The minima are written first: then both sides of the join come straight from a shuffle or a file, so that adaptive
    execution can split the many neighbours of a hub among tasks, or broadcast few minima by their known size.
    """
    return neighbours.join(materialize(neighbours.groupBy("a").agg(F.min("b").alias("m"))), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to its smallest neighbour (or itself)."""
    both = _with_least(edges.union(edges.select("b", "a")))
    return both.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    told = _with_least(edges)
    return told.select("a", F.col("m").alias("b")).union(told.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
