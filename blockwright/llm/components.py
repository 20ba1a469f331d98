"""Distributed connected components with DataFrame operations only.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond").
Each round keeps at most as many edges as before and hangs every node on a smaller one, so the number of rounds
grows with the logarithm of the longest path. A star's centre may own a third of all edges: its minimum is a
partially aggregated ``min`` and the join that hands it back is an ordinary shuffled join, which adaptive
execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u goes to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "c")
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, goes to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that an edge touches; the component is its smallest node.

    Nulls in either column and self loops are no edges; repeated edges count once; an empty table gives no rows.
    """
    now = cut(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = None
    while True:
        # Finished when every edge hangs a node straight on a root: each u once, and no v that is itself hung up.
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not sums["n"] or (sums["n"], sums["h"]) == mark:
            break
        mark = (sums["n"], sums["h"])
        now = cut(packed(_small_star(packed(_large_star(packed(now, mark[0])), mark[0])), mark[0]))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
