"""Snapshot comparison by full outer joins on the keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.operators import local
from srcgraph.operators.build import degrees
from srcgraph.operators.components import scc, wcc
from srcgraph.operators.cycles import cycle_edges, simple_cycles
from srcgraph.stage import Stage

TRACKED = ["import_count", "imported_by_count", "pagerank"]


def diff_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``repo, id, change_type`` and from/to/diff of the tracked columns."""
    a = before.select("repo", "id", F.lit(1).alias("a"), *[F.col(c).alias(f"{c}_from") for c in TRACKED])
    b = after.select("repo", "id", F.lit(1).alias("b"), *[F.col(c).alias(f"{c}_to") for c in TRACKED])
    same = reduce(lambda x, y: x & y,
                  [F.col(f"{c}_from").eqNullSafe(F.col(f"{c}_to")) for c in TRACKED])
    kind = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
        .when(same, "unchanged").otherwise("modified"))
    rows = a.join(b, ["repo", "id"], "full").withColumn("change_type", kind)
    for c in TRACKED:
        rows = rows.withColumn(f"{c}_diff", F.when(
            F.col("change_type") == "modified",
            F.coalesce(f"{c}_to", F.lit(0)) - F.coalesce(f"{c}_from", F.lit(0))))
    return rows.drop("a", "b")


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """``repo, source, target, change_type``."""
    key = ["repo", "source", "target"]
    a = before.select(*key).distinct().withColumn("a", F.lit(1))
    b = after.select(*key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full").select(*key, F.when(F.col("a").isNull(), "added").when(
        F.col("b").isNull(), "removed").otherwise("unchanged").alias("change_type"))


def unpivot_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    """``repo, metric, value`` rows of a metrics table."""
    return metrics.select("repo", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        ["repo"], names, "metric", "value")


def diff_metrics(before: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    """Change, change percent (null from 0) and the 10 % flag per metric."""
    a = unpivot_metrics(before, names).withColumnRenamed("value", "value_1")
    b = unpivot_metrics(after, names).withColumnRenamed("value", "value_2")
    pct = F.when(F.col("value_1") != 0, F.col("change") / F.col("value_1") * 100)
    return a.join(b, ["repo", "metric"]).withColumn(
        "change", F.col("value_2") - F.col("value_1")
    ).withColumn("change_percent", pct).withColumn(
        "significant", F.coalesce(F.abs("change_percent") > 10, F.lit(False)))


def diff_summary(nodes: DataFrame, edges: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Counts of node and edge changes per repo, with the significant metrics."""
    def count(df: DataFrame, kind: str):
        return F.sum((F.col("change_type") == kind).cast("long"))

    n = nodes.groupBy("repo").agg(*[
        count(nodes, k).alias(f"nodes_{k}") for k in ("added", "removed", "modified", "unchanged")])
    e = edges.groupBy("repo").agg(*[
        count(edges, k).alias(f"edges_{k}") for k in ("added", "removed", "unchanged")])
    out = n.join(e, "repo", "full").na.fill(0)
    out = out.withColumn("nodes_total_change", F.col("nodes_added") + F.col("nodes_removed")
                         + F.col("nodes_modified")).withColumn(
        "edges_total_change", F.col("edges_added") + F.col("edges_removed"))
    if metrics is None:
        return out
    flagged = metrics.where("significant").groupBy("repo").agg(
        F.array_sort(F.collect_list("metric")).alias("significant_changes"))
    return out.join(flagged, "repo", "left").withColumn("significant_changes", F.coalesce(
        "significant_changes", F.array().cast("array<string>")))


def changed_cycles(nodes_1: DataFrame, edges_1: DataFrame, nodes_2: DataFrame, edges_2: DataFrame) -> DataFrame:
    """Elementary cycles that only one snapshot has: ``repo, cycle, length, change_type``.

    A cycle of one snapshot alone uses an edge of that snapshot alone.  So only strong components that
    hold such an edge are searched; the cycles of all others are the same on both sides.
    """
    stage = Stage(edges_1.sparkSession, "changed_cycles")
    key = ["repo", "source", "target"]
    changes, _ = stage.save(diff_edges(edges_1, edges_2).where("change_type <> 'unchanged' AND source <> target"))
    found = []
    for nodes, edges, kind in ((nodes_1, edges_1, "removed"), (nodes_2, edges_2, "added")):
        own = changes.where(F.col("change_type") == kind).select(*key)
        labels, _ = stage.save(scc(nodes, edges).select("repo", "id", "scc"))
        one = labels.select("repo", F.col("id").alias("source"), F.col("scc").alias("a"))
        two = labels.select("repo", F.col("id").alias("target"), F.col("scc").alias("b"))
        touched = own.join(one, ["repo", "source"]).join(two, ["repo", "target"]).where("a = b").select(
            "repo", F.col("a").alias("scc")).distinct()
        searched, _ = stage.save(labels.join(touched, ["repo", "scc"], "left_semi").select("repo", "id", "scc"))
        rings, _ = stage.save(simple_cycles(searched, edges, labels=searched)[0])
        using = cycle_edges(rings).join(own, key, "left_semi").select("repo", "cycle").distinct()
        found.append(rings.join(using, ["repo", "cycle"], "left_semi").withColumn("change_type", F.lit(kind)))
    return found[0].unionByName(found[1])


QUICK = ["total_files", "total_imports", "max_import_depth"]


def quick_compare(
    nodes_1: DataFrame, edges_1: DataFrame, nodes_2: DataFrame, edges_2: DataFrame,
    metrics_1: DataFrame, metrics_2: DataFrame,
) -> DataFrame:
    """Set differences and before/after/change of four metrics, one row per repo.

    The change of circular dependencies is exact and comes from ``changed_cycles``.  Their number before
    is that of ``metrics_1`` (null where it was not counted), the number after is that plus the change.
    """
    key = ["repo", "id"]
    n = nodes_1.select(*key).distinct().withColumn("a", F.lit(1)).join(
        nodes_2.select(*key).distinct().withColumn("b", F.lit(1)), key, "full").groupBy("repo").agg(
        F.sum(F.col("a").isNull().cast("long")).alias("added_nodes"),
        F.sum(F.col("b").isNull().cast("long")).alias("removed_nodes"))
    e = diff_edges(edges_1, edges_2).groupBy("repo").agg(
        F.sum((F.col("change_type") == "added").cast("long")).alias("added_edges"),
        F.sum((F.col("change_type") == "removed").cast("long")).alias("removed_edges"))
    rings = changed_cycles(nodes_1, edges_1, nodes_2, edges_2).groupBy("repo").agg(
        F.sum((F.col("change_type") == "added").cast("long")).alias("added_cycles"),
        F.sum((F.col("change_type") == "removed").cast("long")).alias("removed_cycles"))
    m1 = metrics_1.select("repo", *[F.col(c).alias(f"{c}_before") for c in [*QUICK, "circular_dependencies"]])
    m2 = metrics_2.select("repo", *[F.col(c).alias(f"{c}_after") for c in QUICK])
    out = m1.join(m2, "repo").join(n, "repo", "left").join(e, "repo", "left").join(
        rings, "repo", "left").na.fill(0, [f"{way}_{what}" for what in ("nodes", "edges", "cycles")
                                           for way in ("added", "removed")])
    for c in QUICK:
        out = out.withColumn(f"{c}_change", F.col(f"{c}_after") - F.col(f"{c}_before"))
    out = out.withColumn("circular_dependencies_change", F.col("added_cycles") - F.col("removed_cycles"))
    out = out.withColumn("circular_dependencies_after", F.col("circular_dependencies_before")
                         + F.col("circular_dependencies_change"))
    return out.withColumn(
        "impact_score", F.abs(F.col("added_nodes") - F.col("removed_nodes"))
        + F.abs(F.col("added_edges") - F.col("removed_edges"))
    ).withColumn("improvement", F.col("circular_dependencies_change") < 0)


def triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected triangles at each node: ``repo, id, triangles``.

    Every undirected edge points from its lower-degree end to the higher one, so the
    out-list of a hub stays short (at most sqrt(2E)); wedges are joined per middle
    node from these lists and closed by an equi-join with the edges.
    """
    und = _undirected(edges)
    deg = und.select("repo", F.explode(F.array("a", "b")).alias("id")).groupBy("repo", "id").agg(
        F.count(F.lit(1)).alias("d"))
    rank_a = F.struct(F.col("da").alias("d"), F.col("a").alias("i"))
    rank_b = F.struct(F.col("db").alias("d"), F.col("b").alias("i"))
    pointed = (
        und.join(deg.select("repo", F.col("id").alias("a"), F.col("d").alias("da")), ["repo", "a"])
        .join(deg.select("repo", F.col("id").alias("b"), F.col("d").alias("db")), ["repo", "b"])
        .select("repo",
                F.when(rank_a < rank_b, F.col("a")).otherwise(F.col("b")).alias("lo"),
                F.when(rank_a < rank_b, F.col("b")).otherwise(F.col("a")).alias("hi"),
                F.when(rank_a < rank_b, rank_b).otherwise(rank_a).alias("rank")))
    one = pointed.select("repo", "lo", F.col("hi").alias("x"), F.col("rank").alias("rx"))
    two = pointed.select("repo", "lo", F.col("hi").alias("y"), F.col("rank").alias("ry"))
    wedge = one.join(two, ["repo", "lo"]).where("rx < ry")
    close = pointed.select("repo", F.col("lo").alias("x"), F.col("hi").alias("y"))
    found = wedge.join(close, ["repo", "x", "y"])
    return found.select("repo", F.explode(F.array("lo", "x", "y")).alias("id")).groupBy(
        "repo", "id").agg(F.count(F.lit(1)).alias("triangles"))


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.where("source <> target").select(
        "repo", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    ).distinct()


def graph_shape(nodes: DataFrame, edges: DataFrame, deg: DataFrame | None = None) -> DataFrame:
    """Totals, degrees, density, weak components, connectivity and clustering.

    Repositories that fit a task are measured there in one pass (``local``); ``deg`` is ``degrees`` for the others, if
    it is known.
    """
    got, large = local.by_repo(
        nodes, edges, local.shape,
        "total_nodes long, total_edges long, degrees long, max_degree long, num_components long, c double")
    got = got.withColumn("avg_degree", F.bround(F.col("degrees") / F.col("total_nodes"), 4)).drop("degrees")
    if large is not None:
        got = got.unionByName(_shape_by_frames(
            local.only(nodes, large), local.only(edges, large), None if deg is None else local.only(deg, large)))
    dens = F.when(F.col("total_nodes") > 1, F.bround(
        F.col("total_edges") / (F.col("total_nodes") * (F.col("total_nodes") - 1)), 4)).otherwise(0.0)
    return got.select(
        "repo", "total_nodes", "total_edges", "avg_degree", "max_degree", dens.alias("density"),
        "num_components", (F.col("num_components") == 1).alias("is_connected"),
        F.bround(F.coalesce("c", F.lit(0.0)) / F.col("total_nodes"), 6).alias("avg_clustering"))


def _shape_by_frames(nodes: DataFrame, edges: DataFrame, deg: DataFrame | None) -> DataFrame:
    d = (degrees(nodes, edges) if deg is None else deg).withColumn("degree", F.col("import_count") + F.col("imported_by_count"))
    n = d.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_nodes"), F.sum("import_count").alias("total_edges"),
        F.bround(F.avg("degree"), 4).alias("avg_degree"), F.max("degree").alias("max_degree"))
    und = _undirected(edges).select("repo", F.explode(F.array("a", "b")).alias("id")).groupBy(
        "repo", "id").agg(F.count(F.lit(1)).alias("d"))
    around = und.join(triangles(nodes, edges), ["repo", "id"], "left").where("d > 1").select(
        "repo", (2 * F.coalesce("triangles", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).alias("c"))
    cl = around.groupBy("repo").agg(F.sum("c").alias("c"))
    parts = wcc(nodes, edges).where("id = component").groupBy("repo").agg(
        F.count(F.lit(1)).alias("num_components"))
    return n.join(parts, "repo").join(cl, "repo", "left")
