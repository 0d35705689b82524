"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.operators.spread import attach
from adlens.session import checked


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root being the smallest node reachable.

    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller
    ones and the node itself; edges never outnumber those at the start, and the rounds grow with
    the logarithm of the longest path. Minima are pre-aggregated, and ``attach`` hands them out
    over a shuffle of its own, so the partition of a node with very many neighbours is split. Each
    round is cut by a checkpoint; only a count and a checksum reach the driver. Repeated edges and
    loops are harmless, edges with a null end are left out, no edges give no rows.
    """
    edges = checked(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        edges = checked(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour of u that is larger than u goes to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return attach(both.where("v > u"), least, ["u"], by=["v"], how="inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of u, and u itself, go to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = attach(edges, least, ["u"], by=["v"], how="inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
