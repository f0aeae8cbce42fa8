"""Folder roll-ups, folder-scoped metrics and collapsed views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.functions.paths import base_name, folder_path, is_under_folder, path_prefixes
from srcgraph.operators.components import scc
from srcgraph.operators.traverse import node_depth
from srcgraph.stage import Stage

CLUSTER_PREFIX = "cluster:"


def _inner(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type <> 'external'")


def _placed(nodes: DataFrame) -> DataFrame:
    """Nodes with their ``directory``, which a caller of several operators may have written already."""
    return nodes if "directory" in nodes.columns else nodes.withColumn("directory", folder_path("file_path"))


def folder_members(nodes: DataFrame, *columns: str) -> DataFrame:
    """Every internal node under each of its folders: ``repo, folder, id`` and further columns."""
    return _inner(_placed(nodes)).where("directory <> ''").select(
        "repo", F.explode(path_prefixes("directory")).alias("folder"), "id", *columns)


def folder_subgraph(nodes: DataFrame, edges: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Internal nodes under one folder and the edges between them."""
    inner = _inner(nodes).where(is_under_folder("file_path", F.lit(folder)))
    return inner, _edges_among(inner, edges)


def _edges_among(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("repo", "id")
    return edges.join(ids.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi").join(
        ids.withColumnRenamed("id", "target"), ["repo", "target"], "left_semi")


def folder_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges inside each folder, all folders at once: ``repo, folder, source, target``.

    The shared folders of both ends are the common prefixes of their paths, so the
    edge list is joined with the node paths and then exploded.
    """
    path = _inner(_placed(nodes)).select("repo", "id", F.col("directory").alias("d"))
    ends = (
        edges.select("repo", "source", "target").distinct()
        .join(path.select("repo", F.col("id").alias("source"), F.col("d").alias("ds")),
              ["repo", "source"])
        .join(path.select("repo", F.col("id").alias("target"), F.col("d").alias("dt")),
              ["repo", "target"])
        .where("ds <> '' AND dt <> ''"))
    common = F.array_intersect(path_prefixes("ds"), path_prefixes("dt"))
    return ends.select("repo", F.explode(common).alias("folder"), "source", "target")


def _scoped(df: DataFrame, *columns) -> DataFrame:
    """Use (repo, folder) as the portfolio key, so graph operators run per folder."""
    return df.select(F.struct("repo", "folder").alias("repo"), *columns)


def _unscoped(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "repo"]
    return df.select(F.col("repo.repo").alias("repo"), F.col("repo.folder").alias("folder"), *rest)


def folder_depth(nodes: DataFrame, edges: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """Largest of the nearest-entry distances inside each folder; ``inside`` is ``folder_edges``, if it is known."""
    inside = folder_edges(nodes, edges) if inside is None else inside
    depth = node_depth(_scoped(folder_members(nodes), "id"), _scoped(inside, "source", "target"))
    return _unscoped(depth.groupBy("repo").agg(F.max("depth").alias("max_import_depth")))


def folder_cycles(nodes: DataFrame, edges: DataFrame, inside: DataFrame | None = None) -> DataFrame:
    """Components of more than one node inside each folder, and the largest one."""
    inside = folder_edges(nodes, edges) if inside is None else inside
    parts = scc(_scoped(folder_members(nodes), "id"), _scoped(inside, "source", "target"))
    size = parts.groupBy("repo", "scc").agg(F.count(F.lit(1)).alias("size"))
    big = F.when(F.col("size") > 1, F.col("size"))
    return _unscoped(size.groupBy("repo").agg(
        F.count(big).alias("total_cycles"),
        F.coalesce(F.max(big), F.lit(0)).alias("largest_scc_size")))


def folder_degrees(nodes: DataFrame, edges: DataFrame, inside: DataFrame | None = None, *columns: str) -> DataFrame:
    """Degrees inside each folder: ``repo, folder, id, import_count, imported_by_count`` and columns of the node."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    inside = folder_edges(nodes, edges) if inside is None else inside
    ends = inside.select("repo", "folder", F.explode(F.array(
        F.struct(F.col("source").alias("id"), one.alias("o"), zero.alias("i")),
        F.struct(F.col("target").alias("id"), zero.alias("o"), one.alias("i")))).alias("e")
    ).select("repo", "folder", "e.*", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in columns])
    base = folder_members(nodes, *columns).select("repo", "folder", "id", zero.alias("o"), zero.alias("i"), *columns)
    return ends.unionByName(base).groupBy("repo", "folder", "id").agg(
        F.sum("o").alias("import_count"), F.sum("i").alias("imported_by_count"),
        *[F.max(c).alias(c) for c in columns])


def external_touch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Outside nodes that touch each folder, by kind, and the edges that do it.

    Outside means outside the folder: externals and files of other folders.
    """
    prefixes = _placed(nodes).select(
        "repo", "id",
        F.when(F.col("node_type") == "external", F.array().cast("array<string>"))
        .when(F.col("directory") == "", F.array().cast("array<string>"))
        .otherwise(path_prefixes("directory")).alias("p"),
        F.when(F.col("node_type") == "external", F.coalesce("external_kind", F.lit("package")))
        .alias("kind"))
    ends = (
        edges.select("repo", "source", "target").distinct()
        .join(prefixes.select("repo", F.col("id").alias("source"), F.col("p").alias("ps"),
                              F.col("kind").alias("ks")), ["repo", "source"])
        .join(prefixes.select("repo", F.col("id").alias("target"), F.col("p").alias("pt"),
                              F.col("kind").alias("kt")), ["repo", "target"]))
    out = ends.select("repo", F.explode(F.array_except("ps", "pt")).alias("folder"),
                      F.col("target").alias("id"), F.col("kt").alias("kind"))
    inn = ends.select("repo", F.explode(F.array_except("pt", "ps")).alias("folder"),
                      F.col("source").alias("id"), F.col("ks").alias("kind"))
    per = out.unionByName(inn).groupBy("repo", "folder", "id").agg(
        F.count(F.lit(1)).alias("n"), F.first("kind", ignorenulls=True).alias("kind"))
    return per.groupBy("repo", "folder").agg(
        F.count(F.lit(1)).alias("external_node_count"), F.sum("n").alias("external_edges"),
        F.sum((F.col("kind") == "stdlib").cast("long")).alias("stdlib"),
        F.sum((F.col("kind") == "package").cast("long")).alias("package"),
    ).select("repo", "folder", "external_node_count", "external_edges",
             F.coalesce("stdlib", F.lit(0)).alias("external_stdlib_count"),
             F.coalesce("package", F.lit(0)).alias("external_package_count"))


def largest_file(nodes: DataFrame) -> DataFrame:
    """Largest file under each folder by size, then line count; ties go to the smaller id."""
    best = F.min_by(F.struct("file_path", "size_bytes", "line_count", "id"), F.struct(
        -F.col("size_bytes"), -F.coalesce("line_count", F.lit(0)), F.col("id"))).alias("f")
    # the largest of each directory first, so that only one row a directory goes to all folders above it
    own = _inner(_placed(nodes)).where(
        "directory <> '' AND size_bytes IS NOT NULL AND (size_bytes > 0 OR coalesce(line_count, 0) > 0)"
    ).groupBy("repo", "directory").agg(best)
    pick = own.select("repo", F.explode(path_prefixes("directory")).alias("folder"), "f.*").groupBy(
        "repo", "folder").agg(best)
    return pick.select("repo", "folder", F.col("f.file_path").alias("largest_file_path"),
                       F.col("f.size_bytes").alias("largest_file_size_bytes"),
                       F.col("f.line_count").alias("largest_file_line_count"))


def folder_statistics(
    nodes: DataFrame, edges: DataFrame, n: int = 10, inside: DataFrame | None = None,
) -> DataFrame:
    """Counts and import statistics of every folder."""
    # three frames read it
    d, _ = Stage(edges.sparkSession, "folder_degrees").save(folder_degrees(nodes, edges, inside, "file_path"))
    d = d.withColumn("label", base_name("file_path"))
    key = ["repo", "folder"]
    arg = lambda c, v: F.min_by(v, F.struct(-F.col(c), F.col("id")))
    base = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("import_count").alias("total_imports"),
        F.sum((F.col("imported_by_count") == 0).cast("long")).alias("entry_points_count"),
        F.sum(((F.col("imported_by_count") == 0) & (F.col("import_count") == 0)).cast("long"))
        .alias("isolated_count"),
        F.avg("import_count").alias("avg_imports_per_file"),
        F.max("import_count").alias("max_imports_in_file"),
        arg("import_count", "file_path").alias("max_imports_file"),
        arg("imported_by_count", "label").alias("most_imported_module"),
        F.max("imported_by_count").alias("most_imported_count"))

    def top(column: str, name: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.col(column).desc(), "id")
        rows = d.where(F.col(column) > 0).withColumn("rn", F.row_number().over(order)).where(
            F.col("rn") <= n)
        return rows.groupBy(*key).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "label", F.col(column).alias("v")))),
            lambda x: F.struct(x["label"].alias("module"), x["v"].alias("count"))).alias(name))

    possible = F.col("total_files") * (F.col("total_files") - 1)
    return reduce(lambda a, b: a.join(b, key, "left"), [
        base, top("import_count", "top_importers"),
        top("imported_by_count", "top_imported")]
    ).withColumn("graph_density", F.when(
        F.col("total_files") > 1, F.col("total_imports") / possible).otherwise(0.0)
    ).withColumn("hub_modules", F.transform("top_imported", lambda x: F.struct(
        x["module"].alias("module"), (x["count"] / F.col("total_files")).alias("score"))))


def folder_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All folder metrics, one row per (repo, folder)."""
    key = ["repo", "folder"]
    # directories and the edges inside folders are found once
    stage = Stage(edges.sparkSession, "folder_metrics")
    nodes, _ = stage.save(_placed(nodes))
    inside, _ = stage.save(folder_edges(nodes, edges))
    out = reduce(lambda a, b: a.join(b, key, "left"), [
        folder_statistics(nodes, edges, inside=inside), folder_depth(nodes, edges, inside),
        folder_cycles(nodes, edges, inside), external_touch(nodes, edges), largest_file(nodes)])
    for name in ("external_node_count", "external_edges", "external_stdlib_count",
                 "external_package_count"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    touching = F.col("total_imports") + F.col("external_edges")
    return out.withColumn("internal_edges", F.col("total_imports")).withColumn(
        "external_edges_ratio",
        F.when(touching > 0, F.col("external_edges") / touching).otherwise(0.0))


def group_by_folder(nodes: DataFrame) -> DataFrame:
    """Internal nodes per direct folder, the root as ''."""
    return _inner(nodes).groupBy("repo", folder_path("file_path").alias("folder")).agg(
        F.count(F.lit(1)).alias("files"))


def collapse_folders(
    nodes: DataFrame, edges: DataFrame, collapsed: DataFrame, lines: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Replace the nodes of the collapsed folders (``repo, folder``) by cluster nodes.

    Parallel edges merge with their count and all line numbers; an edge inside one
    collapsed folder stays as a self edge of its cluster.  ``lines=False`` leaves
    out the line numbers, whose list grows with the edges of a cluster pair.
    """
    folder = F.when(F.col("node_type") != "external", folder_path("file_path"))
    flag = collapsed.select("repo", "folder").distinct().withColumn("hit", F.lit(True))
    placed = nodes.select("repo", "id", folder.alias("folder")).join(flag, ["repo", "folder"], "left")
    named = placed.select("repo", "id", F.when(
        F.col("hit"), F.concat(F.lit(CLUSTER_PREFIX), F.col("folder"))
    ).otherwise(F.col("id").cast("string")).alias("view"), F.coalesce("hit", F.lit(False)).alias("hit"),
        "folder")
    view = named.groupBy("repo", F.col("view").alias("id")).agg(
        F.when(F.first("hit"), "cluster").otherwise("node").alias("kind"),
        F.count(F.lit(1)).alias("node_count"),
        F.when(F.first("hit"), F.when(F.first("folder") == "", "(root)")
               .otherwise(base_name(F.first("folder")))).alias("label"))
    ends = (
        edges.join(named.select("repo", F.col("id").alias("source"), F.col("view").alias("vs")),
                   ["repo", "source"])
        .join(named.select("repo", F.col("id").alias("target"), F.col("view").alias("vt")),
              ["repo", "target"]))
    listed = F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("source", "target", "line_numbers"))),
        lambda x: x["line_numbers"])).alias("line_numbers")
    merged = ends.groupBy("repo", F.col("vs").alias("source"), F.col("vt").alias("target")).agg(
        F.count(F.lit(1)).alias("count"),
        F.min_by("import_type", F.struct("source", "target")).alias("import_type"),
        *([listed] if lines else []))
    return view, merged


def folder_rollup(nodes: DataFrame) -> DataFrame:
    """Path-prefix tree of module nodes: ``repo, path, name, depth, is_dir, files``.

    A chain of single folders at the root is flattened away.
    """
    mods = nodes.where("node_type = 'module' AND file_path <> ''")
    size = F.size(F.split("file_path", "/"))
    rows = mods.select("repo", "file_path", F.posexplode(path_prefixes("file_path"))
                       .alias("i", "path"), size.alias("len"))
    tree = rows.groupBy("repo", "path").agg(
        F.max((F.col("i") + 1 < F.col("len")).cast("int")).alias("d"),
        F.max("i").alias("i"), F.count(F.lit(1)).alias("files"))
    total = mods.groupBy("repo").agg(F.count(F.lit(1)).alias("all"))
    # a folder holding all files of the repo is a link of the flattened chain
    return tree.join(total, "repo").where("NOT (d = 1 AND files = all)").select(
        "repo", "path", base_name("path").alias("name"), (F.col("i") + 1).alias("depth"),
        (F.col("d") == 1).alias("is_dir"), "files")


def rollup_order(tree: DataFrame) -> DataFrame:
    """Listing order inside a parent: folders first, then by name."""
    return tree.orderBy("repo", folder_path("path"), F.col("is_dir").desc(), F.lower("name"))


def view_filter(
    nodes: DataFrame, edges: DataFrame, folder: str | None = None, stdlib: bool = False,
    packages: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Internal nodes (of a folder) plus the shown externals that touch them."""
    inner = _inner(nodes)
    if folder:
        inner = inner.where(is_under_folder("file_path", F.lit(folder)))
    shown = [k for k, on in (("stdlib", stdlib), ("package", packages)) if on]
    outer = nodes.where("node_type = 'external'").where(
        F.coalesce("external_kind", F.lit("package")).isin(shown))
    ids = inner.select("repo", "id")
    touch = (
        edges.join(ids.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi")
        .select("repo", F.col("target").alias("id"))
        .unionByName(
            edges.join(ids.withColumnRenamed("id", "target"), ["repo", "target"], "left_semi")
            .select("repo", F.col("source").alias("id"))))
    keep = inner.unionByName(outer.join(touch, ["repo", "id"], "left_semi"))
    return keep, _edges_among(keep, edges)


def degree_view(edges: DataFrame) -> DataFrame:
    """Total degree in a (collapsed) edge list."""
    return edges.select("repo", F.explode(F.array("source", "target")).alias("id")).groupBy(
        "repo", "id").agg(F.count(F.lit(1)).alias("degree"))
