"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a map-side combined minimum per node and a join, so a node with very
many links is neither collected nor met by one task (the joins are sort-merge
joins that adaptive execution can split). The number of rounds grows with the
logarithm of the longest path. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ordersight.llm.common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    return (both.join(least, F.col("u") == F.col("n")).where("v > u")
                .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)`` that is not its component's smallest node."""
    stars = (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stars = scratch.table(stars, f"{name}-0")
    seen, k = None, 0
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, k = mark, k + 1
        stars = scratch.table(_small(_large(stars)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
