"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tremorframe.session import stage_table


def state(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free digest of a set of edges."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
    return row[0], row[1]


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` pairs of comparable ids to ``(node, component)``, the smallest id reachable.

    Nodes that are their own component are left out. Every round is written and
    read back, which cuts the lineage; a hub's edges are one side of a join that
    Spark can split.
    """
    turned = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = stage_table(turned.distinct(), "edges")
    before = state(current)
    while True:
        current = stage_table(small_star(large_star(current)), "edges")
        after = state(current)
        if after == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
