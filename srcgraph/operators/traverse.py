"""Breadth-first traversal: one join and one aggregation per level.

``edges`` carries ``repo, source, target``; ids may be of any orderable type.
Visited rows are appended level by level, never rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.operators import local
from srcgraph.stage import Stage


def reverse(edges: DataFrame) -> DataFrame:
    """Edges with the direction turned round."""
    return edges.select("repo", F.col("target").alias("source"), F.col("source").alias("target"))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = -1, avoid: str | None = None) -> DataFrame:
    """Distance from the seeds.

    ``seeds`` has ``repo, id`` and any further key columns (such as ``origin``);
    the search runs per key.  ``avoid`` names a key column with a node that this
    search never enters.  Result: the seed columns plus ``dist INT``, the seeds
    themselves at 0.
    """
    stage = Stage(edges.sparkSession, "bfs")
    keys = [c for c in seeds.columns if c != "id"]
    links = edges.select("repo", "source", "target")
    level = seeds.select(*keys, "id").distinct().withColumn("dist", F.lit(0))
    schema = level.schema
    path, got = stage.write(level, n=F.count(F.lit(1)))
    paths, depth = [path], 0
    while got["n"] and (max_depth < 0 or depth < max_depth):
        depth += 1
        frontier = stage.read(schema, path).select(*keys, F.col("id").alias("source"))
        step = frontier.join(links, ["repo", "source"]).select(
            *keys, F.col("target").alias("id"), F.lit(depth).alias("dist"))
        if avoid:
            step = step.where(F.col("id") != F.col(avoid))
        # steps and visited rows meet in one aggregation; a node is new if no row is older
        level = (
            step.unionByName(stage.read(schema, *paths)).groupBy(*keys, "id")
            .agg(F.min("dist").alias("dist")).where(F.col("dist") == depth))
        path, got = stage.write(level, n=F.count(F.lit(1)))
        paths = stage.compact(schema, [*paths, path])
    return stage.read(schema, *paths)


def mask_bfs(edges: DataFrame, origins: DataFrame, max_depth: int = -1) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from many origins, 64 of them per row.

    Origins (``repo, id``) are numbered in the order of their first import, so those
    that share a neighbourhood share a chunk.  Result: levels ``repo, chunk, id,
    dist, front`` (a bit per origin that sees the node first at this distance) and
    the numbering ``repo, origin, chunk, bit``.
    """
    stage = Stage(edges.sparkSession, "masks")
    links = edges.select("repo", "source", "target")
    first = links.groupBy("repo", F.col("source").alias("id")).agg(F.min("target").alias("first"))
    order = ["repo", "first", "id"]
    number, _ = stage.save(
        origins.select("repo", "id").distinct().join(first, ["repo", "id"], "left")
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("m", F.monotonically_increasing_id())
        .select("repo", F.col("id").alias("origin"), F.shiftright("m", 6).alias("chunk"),
                F.pmod("m", F.lit(64)).cast("int").alias("bit")))
    level = number.select("repo", "chunk", F.col("origin").alias("id"), F.lit(0).alias("dist"),
                          F.expr("shiftleft(1L, bit)").alias("front"))
    schema = level.schema
    path, got = stage.write(level, n=F.count(F.lit(1)))
    paths, depth = [path], 0
    none = F.lit(0).cast("long")
    while got["n"] and (max_depth < 0 or depth < max_depth):
        depth += 1
        step = (
            stage.read(schema, path).select("repo", "chunk", F.col("id").alias("source"), "front")
            .join(links, ["repo", "source"])
            .select("repo", "chunk", F.col("target").alias("id"), "front", none.alias("seen")))
        seen = stage.read(schema, *paths).select(
            "repo", "chunk", "id", none.alias("front"), F.col("front").alias("seen"))
        fresh = F.col("front").bitwiseAND(F.bitwise_not("seen"))
        level = (
            step.unionByName(seen).groupBy("repo", "chunk", "id")
            .agg(F.bit_or("front").alias("front"), F.bit_or("seen").alias("seen"))
            .select("repo", "chunk", "id", F.lit(depth).alias("dist"), fresh.alias("front"))
            .where("front <> 0"))
        path, got = stage.write(level, n=F.count(F.lit(1)))
        paths = stage.compact(schema, [*paths, path])
    return stage.read(schema, *paths), number


def k_hop(edges: DataFrame, targets: DataFrame, depth: int = -1, direction: str = "in") -> DataFrame:
    """Nodes around each target with their distance, the target left out.

    ``direction='in'`` follows importers, ``'out'`` follows imports.  All
    targets (``repo, id``) are answered in one run: ``repo, origin, id, dist``.  Repositories
    that fit a task are searched there (``local``); for others the search keeps 64 targets a row.
    """
    got, large = local.by_repo(targets, edges, local.pairs(depth), "origin, id, dist integer",
                               reverse=direction == "in")
    if large is None:
        return got
    links = local.only(reverse(edges) if direction == "in" else edges, large)
    levels, number = mask_bfs(links, local.only(targets, large), depth)
    seen = levels.where("dist > 0").select("repo", "chunk", "id", "dist", F.explode(F.expr(
        "filter(sequence(0, 63), b -> getbit(front, b) = 1)")).alias("bit"))
    return got.unionByName(seen.join(number, ["repo", "chunk", "bit"]).select("repo", "origin", "id", "dist"))


def entries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing imports: ``repo, id``."""
    return nodes.select("repo", "id").join(
        edges.select("repo", F.col("target").alias("id")).distinct(), ["repo", "id"], "left_anti"
    )


def node_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distance from the nearest entry node; 0 when no entry reaches the node."""
    got, large = local.by_repo(nodes, edges, local.depths, "id, depth integer")
    if large is None:
        return got
    nodes, edges = local.only(nodes, large), local.only(edges, large)
    dist = bfs(edges, entries(nodes, edges))
    return got.unionByName(
        nodes.select("repo", "id")
        .join(dist, ["repo", "id"], "left")
        .select("repo", "id", F.coalesce("dist", F.lit(0)).alias("depth"))
    )


def max_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest distance from any entry to any node, per repo (0 without entries)."""
    best, large = local.by_repo(nodes, edges, local.deepest, "d integer")
    if large is not None:
        more, links = local.only(nodes, large), local.only(edges, large)
        levels, _ = mask_bfs(links, entries(more, links))
        best = best.unionByName(levels.groupBy("repo").agg(F.max("dist").alias("d")))
    return (
        nodes.select("repo").distinct().join(best, "repo", "left")
        .select("repo", F.coalesce("d", F.lit(0)).alias("max_import_depth"))
    )


def shortest_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame, k: int | None = None) -> DataFrame:
    """One shortest path from every seed (or the first k that do) to every target it reaches.

    Runs backward from the targets (few) and keeps, per (target, node), the
    smallest next hop on a shortest path; paths are then read off by following
    the next hop from the seed.  Result: ``repo, target, entry, path``.
    """
    marks = targets.select("repo", "id", F.lit(1).alias("mark")).unionByName(
        seeds.select("repo", "id", F.lit(2).alias("mark")))
    got, large = local.by_repo(marks, edges, local.chains(k), "target, entry, path ids, rank integer",
                               reverse=True)
    got = got.drop("rank")
    if large is None:
        return got
    edges, seeds, targets = (local.only(x, large) for x in (edges, seeds, targets))
    return got.unionByName(_staged_paths(edges, seeds, targets, k))


def _staged_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame, k: int | None) -> DataFrame:
    spark = edges.sparkSession
    dist = bfs(reverse(edges), targets.select("repo", F.col("id").alias("origin"), "id"))
    links = edges.select("repo", F.col("source").alias("id"), F.col("target").alias("next"))
    ahead = dist.select(
        "repo", "origin", F.col("id").alias("next"), (F.col("dist") + 1).alias("dist")
    )
    hops, _ = Stage(spark, "hops").save(
        links.join(ahead, ["repo", "next"])
        .join(dist, ["repo", "origin", "id", "dist"])
        .groupBy("repo", "origin", "id").agg(F.min("next").alias("next"))
    )
    walk = Stage(spark, "paths")
    state = (
        seeds.select("repo", F.col("id").alias("entry"))
        .join(dist.where("dist > 0").select("repo", "origin", F.col("id").alias("entry")),
              ["repo", "entry"])
        .transform(lambda df: df if k is None else df.withColumn("rn", F.row_number().over(
            Window.partitionBy("repo", "origin").orderBy("entry"))).where(F.col("rn") <= k))
        .select("repo", "origin", "entry", F.col("entry").alias("id"),
                F.array("entry").alias("path"))
    )
    schema = state.schema
    path, got = walk.write(state, n=F.sum((F.col("id") != F.col("origin")).cast("long")))
    done = []
    while True:
        state = walk.read(schema, path)
        done.append(state.where("id = origin"))
        if not got["n"]:
            break
        step = (
            state.where("id <> origin").join(hops, ["repo", "origin", "id"])
            .select("repo", "origin", "entry", F.col("next").alias("id"),
                    F.concat("path", F.array("next")).alias("path"))
        )
        path, got = walk.write(step, n=F.sum((F.col("id") != F.col("origin")).cast("long")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("repo", F.col("origin").alias("target"), "entry", "path")
