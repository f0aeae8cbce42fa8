"""Connected components of links between long keys, by alternating large and small stars.

Every round is one staged table; nothing passes through the driver but a count and a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.stage import Stage


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """``node, root`` of every key in ``links`` (a, b) but the roots; the root is the smallest key."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges, got = stage.save(
        links.select(a.alias("u"), b.alias("v")).where("u <> v").distinct(),
        n=F.count("*"), s=F.sum(F.xxhash64("u", "v") % 1_000_000_007))
    while got["n"]:
        # large star: neighbours above a node move to the smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, _ = stage.save(large)
        # small star: neighbours below a node, and the node, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).distinct()
        before, old = got, edges
        edges, got = stage.save(small, n=F.count("*"), s=F.sum(F.xxhash64("u", "v") % 1_000_000_007))
        stage.drop(large)
        stage.drop(old)
        if got == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
