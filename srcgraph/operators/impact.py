"""Change impact: who is affected, how badly, through which chains."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcgraph.operators import local, spectral
from srcgraph.operators.build import degrees
from srcgraph.operators.dominators import dominators
from srcgraph.operators.traverse import bfs, entries, k_hop, shortest_paths
from srcgraph.stage import Stage


def affected_files(
    nodes: DataFrame, edges: DataFrame, targets: DataFrame, pagerank: DataFrame,
    depth: int = -1, direction: str = "in",
) -> DataFrame:
    """Nodes hit by a change of each target, with distance and importance."""
    hit = k_hop(edges, targets, depth, direction)
    deg = degrees(nodes, edges).select("repo", "id", "imported_by_count")
    return (
        hit.join(pagerank.select("repo", "id", "pagerank"), ["repo", "id"], "left")
        .join(deg, ["repo", "id"], "left")
        .select("repo", F.col("origin").alias("target"), F.col("id").alias("file_path"),
                F.col("dist").alias("distance"),
                F.when(F.col("dist") == 1, "direct").otherwise("transitive").alias("impact_type"),
                F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"),
                F.coalesce("imported_by_count", F.lit(0)).alias("imported_by_count")))


def in_order(affected: DataFrame) -> DataFrame:
    """Listing order: nearest first, then most important."""
    return affected.orderBy("repo", "target", "distance", F.col("pagerank").desc(), "file_path")


def risk_level(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 70, "critical").when(s >= 40, "high").when(s >= 15, "medium").otherwise("low")


def impact_score(
    nodes: DataFrame, affected: DataFrame, targets: DataFrame, pagerank: DataFrame,
    strict_internal: bool = False,
) -> DataFrame:
    """``repo, target, affected_count, impact_score, risk_level`` per asked target.

    The total is all nodes; ``strict_internal`` counts only internal ones.
    Targets that are no node score 0.
    """
    counted = nodes.where("node_type <> 'external'") if strict_internal else nodes
    total = counted.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    hit = affected.groupBy("repo", "target").agg(
        F.count(F.lit(1)).alias("all"), F.sum((F.col("distance") == 1).cast("long")).alias("direct"),
        F.sum("pagerank").alias("mass"))
    known = nodes.select("repo", F.col("id").alias("target"), F.lit(True).alias("known"))
    return _scored(
        targets.select("repo", F.col("id").alias("target"))
        .join(known, ["repo", "target"], "left").join(total, "repo", "left")
        .join(hit, ["repo", "target"], "left")
        .join(pagerank.select("repo", F.col("id").alias("target"), "pagerank"),
              ["repo", "target"], "left"))


def _scored(rows: DataFrame) -> DataFrame:
    """Score and level from ``known, n, all, direct, mass, pagerank`` of a target."""
    one = F.lit(1.0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = (
        F.least(zero("direct") / F.col("n"), one) * 40 + F.least(zero("all") / F.col("n"), one) * 20
        + F.least(zero("pagerank") * 10, one) * 20 + F.least(zero("mass") * 5, one) * 20)
    value = F.when(F.coalesce("known", F.lit(False)) & (F.col("n") > 0),
                   F.bround(F.least(score, F.lit(100.0)), 1)).otherwise(0.0)
    return rows.select("repo", "target", zero("all").alias("affected_count"),
                       value.alias("impact_score"), risk_level(value).alias("risk_level"))


def impact_scores(
    nodes: DataFrame, edges: DataFrame, targets: DataFrame | None, pagerank: DataFrame | None = None, depth: int = -1,
    strict_internal: bool = False,
) -> DataFrame:
    """``impact_score`` of distinct targets (None: every node) without a list of what they hit.

    Without ``pagerank`` the ranks (``spectral.pagerank``, unrounded) are found in the same pass.

    Where a repository fits a task, hits are counted and their ranks added up there; others take
    ``affected_files``.
    """
    counted = F.when(F.col("node_type") != "external", 6).otherwise(2) if strict_internal else F.lit(6)
    rows = nodes.select("repo", "id", (counted + int(targets is None)).alias("mark"))
    if targets is not None:
        rows = rows.unionByName(targets.select("repo", "id", F.lit(1).alias("mark")))
    if pagerank is not None:
        rows = rows.unionByName(pagerank.select(
            "repo", "id", F.lit(8).alias("mark"), F.col("pagerank").alias("value")), True)
    got, large = local.by_repo(
        rows, edges, local.impacts(depth, pagerank is not None),
        "target, all long, direct long, mass double, pagerank double, known boolean, n long", reverse=True)
    out = _scored(got)
    if large is None:
        return out
    nodes, edges = local.only(nodes, large), local.only(edges, large)
    pagerank = spectral.pagerank(nodes, edges) if pagerank is None else local.only(pagerank, large)
    asked = nodes.select("repo", "id") if targets is None else local.only(targets, large)
    return out.unionByName(impact_score(
        nodes, affected_files(nodes, edges, asked, pagerank, depth), asked, pagerank, strict_internal))


def dependency_chains(
    nodes: DataFrame, edges: DataFrame, targets: DataFrame | None, k: int = 3,
    strict_internal: bool = False,
) -> DataFrame:
    """Up to k shortest import chains to each target (None: every node), from the first k entry nodes that reach it."""
    pool = F.when(F.col("node_type") != "external", 2).otherwise(0) if strict_internal else F.lit(2)
    marks = nodes.select("repo", "id", (pool + int(targets is None)).alias("mark")).where("mark > 0")
    if targets is not None:
        marks = marks.unionByName(targets.select("repo", "id", F.lit(1).alias("mark")))
    got, large = local.by_repo(marks, edges, local.chains(k, first=True), "target, entry, path ids, rank integer",
                               reverse=True)
    got = got.select("repo", "target", "rank", F.col("path").alias("chain"))
    if large is None:
        return got
    nodes, edges = local.only(nodes, large), local.only(edges, large)
    targets = nodes if targets is None else local.only(targets, large)
    starts = entries(nodes.where("node_type <> 'external'") if strict_internal else nodes, edges)
    paths = shortest_paths(edges, starts.select("repo", "id"), targets.select("repo", "id"), k)
    rank = Window.partitionBy("repo", "target").orderBy("entry")
    return got.unionByName(
        paths.where(F.size("path") > 1).withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k).select("repo", "target", "rank", F.col("path").alias("chain")))


def _with_stand_ins(pool: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs and roots on which a removed node orphans just what it dominates.

    A pool node that only v imports becomes an entry when v goes.  So v gets a stand-in (``counted``
    false) with v's own importers, which imports such nodes in v's place: it lives on without v,
    and falls with whatever else cuts v off.
    """
    sole = (
        links.groupBy("repo", F.col("target").alias("id"))
        .agg(F.count(F.lit(1)).alias("d")).where("d = 1")
        .join(pool, ["repo", "id"], "left_semi").select("repo", F.col("id").alias("target"), F.lit(True).alias("sole")))
    arcs = (
        links.join(sole, ["repo", "target"], "left").where("source <> target")
        .select("repo", "source", F.col("sole").isNull().alias("source_counted"), F.col("target").alias("id"),
                F.lit(True).alias("counted")))
    doubled = arcs.where("NOT source_counted").select("repo", F.col("source").alias("id")).distinct()
    roots = entries(pool, links).withColumn("counted", F.lit(True))
    silent = lambda df: df.join(doubled, ["repo", "id"], "left_semi").withColumn(
        "counted", F.lit(False))
    return arcs.unionByName(silent(arcs)), roots.unionByName(silent(roots))


def removal_orphans(nodes: DataFrame, edges: DataFrame, strict_internal: bool = False) -> DataFrame:
    """What each node keeps alive, for all nodes at once: ``repo, gone, id, lost``.

    One dominator tree a repository answers for every node, inside a task where the repository fits one
    (``local``), else by staged rounds; rows are those of the answer.  A row with
    ``gone`` tells that removing it orphans ``id``.  Nodes that no entry reaches anyway stand
    once with ``gone`` null and ``lost``; such a node comes alive where the removed node was itself lost
    and the only importer of one on the way: rows with ``gone`` and ``lost`` name these exceptions.
    """
    pool = (nodes.where("node_type <> 'external'") if strict_internal else nodes).select("repo", "id")
    got, large = local.by_repo(pool, edges, local.orphans, "gone, id, lost boolean")
    if large is None:
        return got
    return got.unionByName(_staged_orphans(local.only(pool, large), local.only(edges, large)))


def _staged_orphans(pool: DataFrame, edges: DataFrame) -> DataFrame:
    stage = Stage(edges.sparkSession, "removal")
    links, _ = stage.save(edges.select("repo", "source", "target").distinct())
    arcs, roots = _with_stand_ins(pool, links)
    arcs, _ = stage.save(arcs)
    tree = dominators(arcs, roots).where("counted").select("repo", "id", "path")
    below = (
        tree.join(pool, ["repo", "id"], "left_semi").where("size(path) > 1")
        .select("repo", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("gone"), "id"))
    lost, _ = stage.save(pool.join(tree.select("repo", "id"), ["repo", "id"], "left_anti"))
    # a lost node's only importer is lost too
    opened = (
        arcs.where("counted AND NOT source_counted").select("repo", F.col("source").alias("gone"), "id")
        .join(lost, ["repo", "id"], "left_semi"))
    revived = bfs(links, opened, avoid="gone").join(lost, ["repo", "id"], "left_semi")
    return (
        below.select("repo", "gone", "id", F.lit(False).alias("lost"))
        .unionByName(revived.select("repo", "gone", "id", F.lit(True).alias("lost")))
        .unionByName(lost.select("repo", F.lit(None).cast(below.schema["gone"].dataType).alias("gone"), "id",
                                 F.lit(True).alias("lost"))))


def simulate_removal(
    nodes: DataFrame, edges: DataFrame, targets: DataFrame, strict_internal: bool = False
) -> DataFrame:
    """``repo, target, kind, id`` with kind ``broken_import`` or ``orphaned_file``.

    Each target is removed on its own; a node is orphaned when no entry node of the remaining
    graph reaches it.  ``removal_orphans`` finds them without a search per target; only here are
    the nodes that no entry reaches repeated for every target asked.
    """
    t = targets.select("repo", F.col("id").alias("gone")).join(
        nodes.select("repo", F.col("id").alias("gone")), ["repo", "gone"], "left_semi").distinct()
    broken = edges.select("repo", F.col("target").alias("gone"), F.col("source").alias("id")).join(
        t, ["repo", "gone"], "left_semi").distinct()
    stage = Stage(edges.sparkSession, "orphans")
    found, _ = stage.save(removal_orphans(nodes, edges, strict_internal))
    # few nodes are lost: their own table is small enough to reach the targets where these are
    lost, _ = stage.save(found.where("lost").select("repo", "gone", "id"))
    dead = found.where("NOT lost").select("repo", "gone", "id").join(t, ["repo", "gone"], "left_semi")
    always = t.join(lost.where("gone IS NULL").select("repo", "id"), "repo").where("id <> gone").join(
        lost.where("gone IS NOT NULL"), ["repo", "gone", "id"], "left_anti")
    kind = lambda df, name: df.select("repo", F.col("gone").alias("target"), F.lit(name).alias("kind"), "id")
    return (
        kind(broken, "broken_import").unionByName(kind(dead, "orphaned_file"))
        .unionByName(kind(always, "orphaned_file")))


def _meant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (repo, key, kind, id, size), sorted so, to the node that each argument means.

    Keys are reversed texts, so a text's endings are the keys in front that it starts with: the stack.  An
    entry is [key, node of this text, best node with this ending, best node of this path, asked, longest
    node that is an ending of the text]; nodes are (size, id).
    """
    stack: list[list] = []
    now, out = None, []

    def close() -> None:
        key, _, below, path, asked, ending = stack.pop()
        if asked:
            n = len(key)
            found = [] if path is None else [path]
            if below:
                found.append((-n, below[0] - n, below[1]))
            elif ending:
                found.append((-ending[0], n - ending[0], ending[1]))
            if found:
                out.append((now, key[::-1], min(found)[2]))
        if stack and below and (stack[-1][2] is None or below < stack[-1][2]):
            stack[-1][2] = below

    schema = None
    for batch in batches:
        schema = pa.schema([batch.schema.field(0), pa.field("argument", batch.schema.field(1).type), batch.schema.field(3)])
        for repo, key, kind, node, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while stack and not (repo == now and key.startswith(stack[-1][0])):
                close()
            now = repo
            if not stack or stack[-1][0] != key:
                last = stack[-1] if stack else None
                # an empty id is no ending of a path
                stack.append([key, None, None, None, False, last and (last[1] if last[1] and last[0] else last[5])])
            entry = stack[-1]
            if kind == 2:
                entry[4] = True
            elif kind == 0:
                if entry[1] is None:  # the smallest id, as rows are sorted
                    entry[1] = entry[2] = size, node
            else:
                path = (-min(size, len(key)), abs(size - len(key)), node) if size is not None else (-math.inf, 0, None)
                if entry[3] is None or path < entry[3]:
                    entry[3] = path
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], type=f.type) for i, f in enumerate(schema)], schema=schema)
        out.clear()
    while stack:
        close()
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], type=f.type) for i, f in enumerate(schema)], schema=schema)


def match_target(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Node meant by a path argument: ``repo, argument, id``.

    A node matches when its id or path equals the argument, its id ends with the
    argument, or the argument ends with its id; the longest overlap wins, then the
    closest length.  Ids, paths and arguments of a repo are sorted by their reversed
    texts and read once in that order, so no ending is written; one task reads a repo,
    and holds the nested endings of one text.
    """
    kind = nodes.schema["id"].dataType
    text = F.col("id").cast("string")
    rows = [
        nodes.select("repo", text.alias("key"), F.lit(0).alias("kind"), "id", F.length(text).alias("size")),
        nodes.where(~F.col("file_path").eqNullSafe(text)).select(
            "repo", F.col("file_path").alias("key"), F.lit(1).alias("kind"), "id", F.length(text).alias("size")),
        wanted.select("repo", F.col("argument").alias("key"), F.lit(2).alias("kind"),
                      F.lit(None).cast(kind).alias("id"), F.lit(None).cast("int").alias("size"))]
    return reduce(DataFrame.union, rows).where("repo IS NOT NULL AND key IS NOT NULL").withColumn(
        "key", F.reverse("key")).repartition("repo").sortWithinPartitions("repo", "key", "kind", "id").mapInArrow(
        _meant, T.StructType([T.StructField("repo", nodes.schema["repo"].dataType), T.StructField("argument", T.StringType()),
                              T.StructField("id", kind)]))


def impact_report(
    nodes: DataFrame, edges: DataFrame, targets: DataFrame, pagerank: DataFrame, depth: int = -1,
    strict_internal: bool = False,
) -> dict[str, DataFrame]:
    """The parts of an impact report: ``summary``, ``forward``, ``backward``, ``chains``."""
    forward = affected_files(nodes, edges, targets, pagerank, depth, "in")
    return {
        "summary": impact_scores(nodes, edges, targets, pagerank, depth, strict_internal),
        "forward": forward,
        "backward": affected_files(nodes, edges, targets, pagerank, depth, "out"),
        "chains": dependency_chains(nodes, edges, targets, strict_internal=strict_internal),
    }
