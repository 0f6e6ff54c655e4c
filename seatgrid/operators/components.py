"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatgrid.session import cut_lineage


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """edges (u, v): u with m, the least of u and its neighbours. Combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v) hangs its u under a root, and under that one only."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("hangs")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("hangs")))
    return ends.groupBy("n").agg(F.sum("hangs").alias("up"), F.min("hangs").alias("least")).filter("up > 1 OR up = 1 AND least = 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (n, c): every node of an edge with the least node of its component.

    Each round hangs every node's larger neighbours (large star), then its smaller ones (small star), under
    the least node it knows, until all edges point at roots. Rounds grow with the
    logarithm of the nodes, rows never exceed the edges, and a hub's edges are only joined and counted, never gathered.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least_neighbour(large), "u")
        now = cut_lineage(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                          .unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    nodes = now.select(F.col("u").alias("n"), F.col("v").alias("c"))
    return nodes.unionByName(now.select(F.col("v").alias("n"), F.col("v").alias("c")).distinct())
