"""Simple cycles by path extension inside strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.operators.components import members
from srcgraph.stage import Stage


def simple_cycles(
    nodes: DataFrame, edges: DataFrame, max_len: int | None = None, labels: DataFrame | None = None
) -> tuple[DataFrame, bool]:
    """Every elementary cycle of length > 1: ``repo, cycle ARRAY, length``.

    A cycle starts at its smallest node.  ``max_len`` bounds the length; the
    flag tells whether longer paths were still open, i.e. the list may be
    incomplete.  Without it the search runs to the end.
    """
    spark = edges.sparkSession
    stage = Stage(spark, "cycles")
    # only components of several nodes hold cycles, so few labels meet the edges
    if labels is None:
        labels = members(nodes, edges).withColumnRenamed("label", "scc")
    links = edges.select("repo", "source", "target").where("source <> target")
    links, _ = stage.save(
        links.join(labels.select("repo", F.col("id").alias("source"), F.col("scc").alias("a")),
                   ["repo", "source"])
        .join(labels.select("repo", F.col("id").alias("target"), F.col("scc").alias("b")),
              ["repo", "target"])
        .where("a = b").select("repo", "source", "target").distinct())
    state = links.where("source < target").select(
        "repo", F.col("source").alias("start"), F.col("target").alias("last"),
        F.array("source", "target").alias("path"))
    schema = state.schema
    closed: list[DataFrame] = []
    path, got = stage.write(state, n=F.count(F.lit(1)))
    length = 2
    while got["n"] and (max_len is None or length <= max_len):
        state = stage.read(schema, path)
        step = state.join(
            links.select("repo", F.col("source").alias("last"), "target"), ["repo", "last"])
        closed.append(step.where("target = start").select(
            "repo", F.col("path").alias("cycle"), F.size("path").alias("length")))
        if length == max_len:
            # open paths remain only if some could still be extended
            more = step.where("target > start AND NOT array_contains(path, target)")
            return _union(closed), bool(more.take(1))
        grown = step.where("target > start AND NOT array_contains(path, target)").select(
            "repo", "start", F.col("target").alias("last"),
            F.concat("path", F.array("target")).alias("path"))
        path, got = stage.write(grown, n=F.count(F.lit(1)))
        length += 1
    if not closed:
        empty = state.select("repo", F.col("path").alias("cycle"), F.size("path").alias("length"))
        return empty.where(F.lit(False)), False
    return _union(closed), False


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def cycle_participation(nodes: DataFrame, cycles: DataFrame) -> DataFrame:
    """Number of simple cycles through each node: ``repo, id, cycle_count``."""
    hits = cycles.select("repo", F.explode("cycle").alias("id")).groupBy("repo", "id").agg(
        F.count(F.lit(1)).alias("cycle_count"))
    return nodes.select("repo", "id").join(hits, ["repo", "id"], "left").select(
        "repo", "id", F.coalesce("cycle_count", F.lit(0)).alias("cycle_count"))


def cycle_stats(cycles: DataFrame) -> DataFrame:
    """``repo, total_cycles, avg_cycle_length, max_cycle_length``."""
    return cycles.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_cycles"),
        F.bround(F.avg("length"), 1).alias("avg_cycle_length"),
        F.max("length").alias("max_cycle_length"))


def first_cycles(cycles: DataFrame, n: int | None = None) -> DataFrame:
    """The n shortest cycles of each repo (default all) with their rank (ties: node order)."""
    order = Window.partitionBy("repo").orderBy("length", "cycle")
    ranked = cycles.withColumn("rank", F.row_number().over(order))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def cycle_edges(cycles: DataFrame) -> DataFrame:
    """One row per cycle edge: ``repo, cycle, length, step, source, target``."""
    shifted = F.concat(F.slice("cycle", 2, F.size("cycle") - 1), F.slice("cycle", 1, 1))
    keep = [c for c in cycles.columns]
    return cycles.select(
        *keep, F.posexplode(F.arrays_zip(F.col("cycle").alias("source"), shifted.alias("target")))
        .alias("step", "pair")
    ).select(*keep, "step", F.col("pair.source").alias("source"),
             F.col("pair.target").alias("target"))


def cycle_details(cycles: DataFrame, edges: DataFrame, n: int | None = None) -> DataFrame:
    """First n cycles (default all) with severity and their edges (import type and lines)."""
    rows = cycle_edges(first_cycles(cycles, n)).join(
        edges.select("repo", "source", "target", "import_type", "line_numbers"),
        ["repo", "source", "target"])
    # at most one row per step of one listed cycle, so the list is as long as the cycle
    return rows.groupBy("repo", "rank", "cycle", "length").agg(
        F.transform(
            F.array_sort(F.collect_list(
                F.struct("step", "source", "target", "import_type", "line_numbers"))),
            lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"),
                               e["import_type"].alias("import_type"),
                               e["line_numbers"].alias("line_numbers")),
        ).alias("edges")
    ).withColumn("severity", F.when(F.col("length") <= 3, "high").otherwise("medium"))


def cycle_warnings(cycles: DataFrame, n: int | None = None) -> DataFrame:
    """First n cycles (default all) as text, base names joined by an arrow."""
    return first_cycles(cycles, n).select(
        "repo", "rank",
        F.concat_ws(" → ", F.transform(
            "cycle", lambda p: F.substring_index(p.cast("string"), "/", -1))).alias("warning"))
