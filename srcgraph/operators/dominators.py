"""Dominator trees: which nodes every path from the roots to a node passes.

The tree is kept as one array a node: the counted nodes above it, itself last.  Arrays start as
the paths of a breadth-first tree and only get shorter.  The nearest common ancestor of all
importers of a node is the longest common prefix of their arrays, and that of any number of arrays
is the common prefix of the least and the greatest of them, so a round is one join and one
``min``/``max`` aggregation that combines before the shuffle.  A round reads all arrays of one tree and
moves nodes up to the ancestor found; when none moves, every import comes from below the importing
node's parent, which holds for the dominator tree alone.

Silent nodes (``counted`` false) take part in the search but stand in no array: for callers that
never ask for them, such as the stand-ins of ``impact.simulate_removal``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.stage import Stage

NODE = ["repo", "id", "counted"]


def _spanning(stage: Stage, arcs: DataFrame, roots: DataFrame):
    """Paths of a breadth-first tree from the roots, level by level: schema and tables."""
    itself = F.when(F.col("counted"), F.array("id")).otherwise(F.slice(F.array("id"), 1, 0))
    level = roots.select(*NODE).distinct().withColumn("path", itself)
    schema = level.schema
    path, got = stage.write(level, n=F.count(F.lit(1)))
    paths = [path]
    while got["n"]:
        front = stage.read(schema, path).withColumnsRenamed({"id": "source", "counted": "source_counted"})
        step = (
            front.join(arcs, ["repo", "source", "source_counted"])
            .join(stage.read(schema, *paths).select(*NODE), NODE, "left_anti")
            .groupBy(*NODE).agg(F.min("path").alias("path"))
            .withColumn("path", F.concat("path", itself)))
        path, got = stage.write(step, n=F.count(F.lit(1)))
        paths = stage.compact(schema, [*paths, path])
    return schema, paths


def _common(lo: str, hi: str):
    """Length of the common prefix of two arrays."""
    first = F.array_position(F.zip_with(lo, hi, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(first == 0, F.size(lo)).otherwise(first - 1).cast("int")


def dominators(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """``repo, id, counted, path`` of all nodes that a root reaches.

    ``arcs`` has ``repo, source, source_counted, id, counted`` (an arc to ``id``), ``roots`` has
    ``repo, id, counted``.  ``path`` lists the counted nodes that every walk from the roots to the node
    passes, outermost first, with the node itself if it is counted.  Nodes of several roots hang
    below a root of their own above them, which stands in no array.
    """
    stage = Stage(arcs.sparkSession, "dominators")
    arcs, _ = stage.save(arcs.where("NOT (source = id AND source_counted = counted)").distinct())
    schema, paths = _spanning(stage, arcs, roots)
    tree, _ = stage.save(stage.read(schema, *paths), schema)
    while True:
        # arrays of all importers and the part of a node's own above it
        over = tree.withColumnsRenamed({"id": "source", "counted": "source_counted"}).join(
            arcs, ["repo", "source", "source_counted"]).select(*NODE, "path")
        above = F.slice("path", F.lit(1), F.size("path") - F.col("counted").cast("int"))
        own = tree.select(*NODE, above.alias("path"))
        shorter = (
            over.unionByName(own).groupBy(*NODE)
            .agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
            .withColumn("keep", _common("lo", "hi"))
            .join(own.withColumn("had", F.size("path")).select(*NODE, "had"), NODE)
            .where("keep < had")
            .select(*NODE, (F.col("had") + 1).alias("at"), "keep"))
        moved, got = stage.save(shorter, n=F.count(F.lit(1)))
        if not got["n"]:
            return tree
        # a moved node leaves out the stretch between its new parent and itself, for all below it
        at = tree.select(*NODE, F.posexplode("path").alias("p", "x")).join(
            moved.where("counted").select("repo", F.col("id").alias("x"), "keep"), ["repo", "x"])
        cuts = (
            at.select(*NODE, (F.col("p") + 1).alias("at"), "keep")
            .unionByName(moved.where("NOT counted")).groupBy(*NODE)
            .agg(F.reverse(F.array_sort(F.collect_list(F.struct("at", "keep")))).alias("cuts")))
        # from the node upwards: a stretch counts if its lower end has not been left out itself
        kept = F.aggregate(
            "cuts", F.struct(F.lit(2**31 - 1).alias("next"),
                             F.slice("cuts", 1, 0).alias("done")),
            lambda acc, c: F.when(c["at"] <= acc["next"], F.struct(
                c["keep"].alias("next"), F.concat(acc["done"], F.array(c)).alias("done"))).otherwise(acc),
            lambda acc: acc["done"])
        whole = tree.join(cuts, NODE, "left").withColumn("cuts", F.coalesce(kept, F.expr(
            "CAST(array() AS array<struct<at:int,keep:int>>)")))
        path = F.filter("path", lambda x, i: ~F.exists(
            "cuts", lambda c: (i + 1 > c["keep"]) & (i + 1 < c["at"])))
        old = tree
        tree, _ = stage.save(whole.select(*NODE, path.alias("path")), schema)
        stage.drop(old)
        stage.drop(moved)
