"""Connected components of a link table by hash-to-min with pointer jumping, on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest reachable node); nodes without links are not listed.

    Large-star and small-star steps alternate until no link changes.  Both group by node and keep one
    row per link; a hub's neighbours are handled by a join with its minimum, never gathered.
    """
    edges = stored(
        links.select(
            F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
        ).filter("u > v").distinct(),
        "links",
    )
    while True:
        # large star: every larger neighbour points at the node's minimum
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u > v").distinct()
        )
        # small star: smaller neighbours and the node itself point at the minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .filter("u > v").distinct()
        )
        new = stored(small, "links")
        same = (
            edges.select("u", "v", F.lit(1).alias("w"))
            .union(new.select("u", "v", F.lit(-1).alias("w")))
            .groupBy("u", "v").agg(F.sum("w").alias("w")).filter("w <> 0")
        )
        edges = new
        if same.isEmpty():
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct())
