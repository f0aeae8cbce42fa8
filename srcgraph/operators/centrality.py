"""Closeness and betweenness: level-synchronous search keyed by the source node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.operators import local
from srcgraph.operators.traverse import mask_bfs, reverse
from srcgraph.stage import Stage


def _sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def closeness(
    nodes: DataFrame, edges: DataFrame, direction: str = "out"
) -> DataFrame:
    """``repo, id, closeness`` = (r-1)/sum(d) * (r-1)/(N-1) over the r nodes reached.

    ``direction='out'`` follows imports (the computed form), ``'in'`` follows importers.
    """
    reached, large = local.by_repo(nodes, edges, local.reach, "id, r long, total long, n long",
                                   reverse=direction != "out")
    if large is not None:
        links = local.only(edges if direction == "out" else reverse(edges), large)
        more = local.only(nodes, large).select("repo", "id")
        reached = reached.unionByName(
            more.join(_sizes(more), "repo").join(_reached(links, more), ["repo", "id"], "left"), True)
    value = F.when(
        (F.col("total") > 0) & (F.col("n") > 1),
        (F.col("r") - 1) / F.col("total") * ((F.col("r") - 1) / (F.col("n") - 1)),
    ).otherwise(0.0)
    return reached.select("repo", "id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def _reached(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``repo, id, r, total`` by staged rounds."""
    levels, number = mask_bfs(links, nodes.select("repo", "id"))
    # nodes per level and origin: one sum per bit, then one row per bit
    hits = levels.groupBy("repo", "chunk", "dist").agg(*[
        F.sum(F.shiftright("front", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)])
    return (
        hits.select("repo", "chunk", "dist", F.posexplode(F.array(*[f"b{i}" for i in range(64)]))
                    .alias("bit", "c"))
        .groupBy("repo", "chunk", "bit")
        .agg(F.sum("c").alias("r"), F.sum(F.col("c") * F.col("dist")).alias("total"))
        .join(number, ["repo", "chunk", "bit"])
        .select("repo", F.col("origin").alias("id"), "r", "total"))


def pivots(nodes: DataFrame, k: int | None = None) -> DataFrame:
    """Search origins: every node, or the first ``k`` nodes of each repo in md5 order."""
    base = nodes.select("repo", "id").join(_sizes(nodes), "repo")
    if k is None:
        return base.select("repo", F.col("id").alias("origin"), F.col("n").alias("k"))
    order = Window.partitionBy("repo").orderBy(F.md5(F.col("id").cast("string")), "id")
    return base.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select(
        "repo", F.col("id").alias("origin"), F.least("n", F.lit(k)).alias("k"))


def betweenness(
    nodes: DataFrame,
    edges: DataFrame,
    k: int | None = None,
    batches: int = 1,
) -> DataFrame:
    """``repo, id, betweenness``: directed, endpoints out, over (N-1)(N-2).

    With ``k`` the search starts from k pivots of each repo and is scaled by N/k.  Forward
    levels count shortest paths, backward levels return dependencies; the state
    of one batch is (origin, node) rows.
    """
    marks = nodes.select("repo", "id", F.lit(3 if k is None else 2).alias("mark"))
    if k is not None:
        marks = marks.unionByName(pivots(nodes, k).select("repo", F.col("origin").alias("id"), F.lit(1).alias("mark")))
    got, large = local.by_repo(marks, edges, local.betweenness, "id, delta double, n long, k long")
    if large is not None:
        stage = Stage(edges.sparkSession, "betweenness")
        more = local.only(nodes, large).select("repo", "id")
        links, _ = stage.save(local.only(edges, large).select("repo", "source", "target").where(
            "source <> target").distinct())
        chosen, _ = stage.save(pivots(more, k))
        total = _staged_dependencies(stage, links, chosen, batches, got.select("repo", "id", "delta"))
        got = got.unionByName(
            more.join(_sizes(more), "repo").join(chosen.groupBy("repo").agg(F.max("k").alias("k")), "repo")
            .join(total.groupBy("repo", "id").agg(F.sum("delta").alias("delta")), ["repo", "id"], "left"))
    return got.select("repo", "id", scaled().alias("betweenness"))


def scaled() -> Column:
    """Betweenness from the sum of dependencies ``delta`` of ``k`` among ``n`` nodes."""
    return F.when(
        F.col("n") > 2,
        F.coalesce("delta", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2))
        * (F.col("n") / F.col("k")),
    ).otherwise(0.0)


def _staged_dependencies(
    stage: Stage, links: DataFrame, chosen: DataFrame, batches: int, like: DataFrame,
) -> DataFrame:
    """``repo, id, delta`` by staged rounds, no row where no path has an inner node."""
    total = like.sparkSession.createDataFrame([], like.schema)
    for b in range(batches):
        part = chosen if batches == 1 else chosen.where(
            F.pmod(F.xxhash64("repo", "origin"), F.lit(batches)) == b)
        got = _dependencies(stage, links, part)
        if got is not None:
            total = total.unionByName(got)
    return total


def _dependencies(stage: Stage, links: DataFrame, origins: DataFrame) -> DataFrame | None:
    key = ["repo", "origin", "id"]
    level = origins.select("repo", "origin", F.col("origin").alias("id"),
                           F.lit(1.0).alias("sigma"))
    schema = level.schema
    path, got = stage.write(level, n=F.count(F.lit(1)))
    levels = []
    while got["n"]:
        levels.append(path)
        step = (
            stage.read(schema, path).withColumnRenamed("id", "source")
            .join(links, ["repo", "source"])
            .groupBy("repo", "origin", F.col("target").alias("id"))
            .agg(F.sum("sigma").alias("sigma"))
        )
        seen = stage.read(schema, *levels).select(*key)
        path, got = stage.write(step.join(seen, key, "left_anti"), n=F.count(F.lit(1)))
    if len(levels) < 3:
        return None
    lower = stage.read(schema, levels[-1]).withColumn("delta", F.lit(0.0))
    delta_schema = lower.schema
    kept = []
    for i in range(len(levels) - 2, 0, -1):
        share = (
            lower.select("repo", "origin", F.col("id").alias("target"),
                         ((1.0 + F.col("delta")) / F.col("sigma")).alias("share"))
            .join(links, ["repo", "target"])
            .groupBy("repo", "origin", F.col("source").alias("id"))
            .agg(F.sum("share").alias("share"))
        )
        upper = (
            stage.read(schema, levels[i]).join(share, key, "left")
            .select(*key, "sigma",
                    (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta"))
        )
        path, _ = stage.write(upper)
        kept.append(path)
        lower = stage.read(delta_schema, path)
    return stage.read(delta_schema, *kept).select("repo", "id", "delta")
