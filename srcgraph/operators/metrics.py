"""Project metrics: counts, ratios, import statistics and the metrics report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.operators import components, cycles as cyc, local, spectral, traverse
from srcgraph.operators.build import degrees
from srcgraph.stage import Stage


def with_type(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees next to the node type."""
    return degrees(nodes, edges).join(nodes.select("repo", "id", "node_type"), ["repo", "id"])


def isolated(nodes: DataFrame, edges: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """Internal nodes without edges; ``typed`` is ``with_type``, if it is known."""
    return (with_type(nodes, edges) if typed is None else typed).where(
        "node_type <> 'external' AND import_count = 0 AND imported_by_count = 0"
    ).select("repo", "id")


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Internal nodes that nothing imports."""
    return traverse.entries(nodes.where("node_type <> 'external'"), edges)


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    m = edges.select("repo", "source", "target").distinct().groupBy("repo").agg(
        F.count(F.lit(1)).alias("m"))
    value = F.when(F.col("n") >= 2, F.bround(
        F.coalesce("m", F.lit(0)) / (F.col("n") * (F.col("n") - 1)), 4)).otherwise(0.0)
    return n.join(m, "repo", "left").select("repo", value.alias("graph_density"))


def edge_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts by kind, and the share of edges to externals.

    The kind of both ends reaches the edges by two joins; everything else is one
    aggregation.
    """
    kind = nodes.select("repo", "id", (F.col("node_type") == "external").cast("long").alias("x"))
    links = edges.select("repo", "source", "target").distinct()
    typed = (
        links.join(kind.select("repo", F.col("id").alias("source"), F.col("x").alias("sx")),
                   ["repo", "source"])
        .join(kind.select("repo", F.col("id").alias("target"), F.col("x").alias("tx")),
              ["repo", "target"]))
    e = typed.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.sum(F.when((F.col("sx") == 0) & (F.col("tx") == 0), 1).otherwise(0))
        .alias("internal_edges"),
        F.sum("tx").alias("external_edges"))
    v = kind.groupBy("repo").agg(
        F.sum("x").alias("external_node_count"), F.sum(1 - F.col("x")).alias("total_files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return v.join(e, "repo", "left").select(
        "repo", "total_files", "external_node_count", zero("total_edges"),
        zero("internal_edges"),
        F.when(F.col("total_edges") > 0, F.bround(F.col("external_edges") / F.col("total_edges"), 4))
        .otherwise(0.0).alias("external_edges_ratio"))


def top_by(df: DataFrame, column: str, n: int) -> DataFrame:
    """First n rows per repo by a column, largest first, ties by id.

    Spark keeps n rows per partition before the shuffle, so a large repo does not
    travel whole.
    """
    order = Window.partitionBy("repo").orderBy(F.col(column).desc(), F.col("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hub_modules(scores: DataFrame, n: int = 5) -> DataFrame:
    return top_by(scores, "pagerank", n).select("repo", "rank", "id", "pagerank")


def top_importers(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    return top_by(degrees(nodes, edges), "import_count", n).select(
        "repo", "rank", "id", "import_count")


def top_imported(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    return top_by(degrees(nodes, edges), "imported_by_count", n).select(
        "repo", "rank", "id", "imported_by_count")


def import_statistics(nodes: DataFrame, edges: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """Over internal nodes: average and largest out-degree, largest in-degree."""
    d = (with_type(nodes, edges) if typed is None else typed).where("node_type <> 'external'")
    best = lambda c: F.min_by("id", F.struct(-F.col(c), F.col("id")))
    got = d.groupBy("repo").agg(
        F.bround(F.avg("import_count"), 2).alias("avg_imports_per_file"),
        F.max("import_count").alias("max_imports_in_file"),
        best("import_count").alias("max_imports_file"),
        best("imported_by_count").alias("most_imported_module"),
        F.max("imported_by_count").alias("most_imported_count"))
    return nodes.select("repo").distinct().join(got, "repo", "left").select(
        "repo", F.coalesce("avg_imports_per_file", F.lit(0.0)).alias("avg_imports_per_file"),
        F.coalesce("max_imports_in_file", F.lit(0)).alias("max_imports_in_file"),
        F.coalesce(F.col("max_imports_file").cast("string"), F.lit("")).alias("max_imports_file"),
        F.coalesce(F.col("most_imported_module").cast("string"), F.lit(""))
        .alias("most_imported_module"),
        F.coalesce("most_imported_count", F.lit(0)).alias("most_imported_count"))


def node_importance(scored: DataFrame, asked: DataFrame | list) -> DataFrame:
    """PageRank, betweenness and degrees of the asked nodes (a list of ids, or ``repo, id``)."""
    if isinstance(asked, DataFrame):
        kept = scored.join(asked.select("repo", "id"), ["repo", "id"], "left_semi")
    else:
        kept = scored.where(F.col("id").isin(asked))
    return kept.select(
        "repo", "id", "pagerank", "betweenness", "imported_by_count", "import_count")


def ranked_list(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    """Top n as one array of (module, count) per repo."""
    return top_by(df, column, n).groupBy("repo").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "id", F.col(column).cast("double")
                                                 .alias("v")))),
            lambda x: F.struct(x["id"].cast("string").alias("module"), x["v"].alias("count")),
        ).alias(name))


def _counted(nodes: DataFrame, edges: DataFrame, full: bool) -> tuple[DataFrame, DataFrame | None]:
    """What a report counts without ranks and cycles, of the repositories that fit a task, and the others."""
    kind = F.coalesce(F.when(F.col("node_type") == "external", 5).when(F.col("node_type") != "external", 3), F.lit(1))
    got, large = local.by_repo(
        nodes.select("repo", "id", kind.alias("mark")), edges, local.report(full), local.REPORT)
    # every ratio is taken of whole counts, as in the functions above
    n = F.col("nodes")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    pairs = lambda c: F.zip_with(f"top_{c}", f"{c}_counts", lambda m, v: F.struct(
        m.cast("string").alias("module"), v.alias("count"))).alias(f"top_{c}")
    out = got.select(
        "repo", "total_files", "external_node_count", "total_edges", "internal_edges",
        F.when(F.col("total_edges") > 0, F.bround(F.col("external_edges") / F.col("total_edges"), 4))
        .otherwise(0.0).alias("external_edges_ratio"),
        F.when(n >= 2, F.bround(F.col("links") / (n * (n - 1)), 4)).otherwise(0.0).alias("graph_density"),
        F.when(F.col("total_files") > 0, F.bround(F.col("imports") / F.col("total_files"), 2))
        .otherwise(0.0).alias("avg_imports_per_file"),
        "max_imports_in_file", text("max_imports_file"), text("most_imported_module"), "most_imported_count",
        "isolated_count", "entry_points_count", F.col("d").alias("max_import_depth"),
        pairs("importers"), pairs("imported"), *(["largest_scc_size"] if full else []))
    return out, large


def _counted_by_frames(nodes: DataFrame, edges: DataFrame, full: bool) -> DataFrame:
    per_repo = lambda df, name: df.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    d, _ = Stage(edges.sparkSession, "metrics").save(with_type(nodes, edges))  # five frames read it
    frames = [
        edge_counts(nodes, edges), density(nodes, edges), import_statistics(nodes, edges, d),
        per_repo(isolated(nodes, edges, d), "isolated_count"),
        per_repo(d.where("node_type <> 'external' AND imported_by_count = 0"), "entry_points_count"),
        traverse.max_depth(nodes, edges),
        ranked_list(d, "import_count", "top_importers", 5),
        ranked_list(d, "imported_by_count", "top_imported", 5),
    ]
    if full:
        frames.append(components.largest_scc(nodes, edges))
    return reduce(lambda a, b: a.join(b, "repo", "left"), frames).na.fill(
        0, ["isolated_count", "entry_points_count"])


def metrics_report(
    nodes: DataFrame,
    edges: DataFrame,
    level: str = "full",
    pagerank: DataFrame | None = None,
    max_len: int | None = None,
) -> DataFrame:
    """One row of metrics per repo.  ``level='light'`` leaves out cycles and hubs.

    Repositories that fit a task are counted there in one pass (``local``), others by one frame a group of metrics.
    """
    if level not in ("full", "light"):
        raise ValueError("level is 'full' or 'light'")
    base, large = _counted(nodes, edges, level == "full")
    if large is not None:
        base = base.unionByName(_counted_by_frames(
            local.only(nodes, large), local.only(edges, large), level == "full"))
    frames = [base]
    if level == "full":
        rank = spectral.pagerank(nodes, edges) if pagerank is None else pagerank
        rings, cut = cyc.simple_cycles(nodes, edges, max_len)
        frames += [ranked_list(rank, "pagerank", "hub_modules", 5), cyc.cycle_stats(rings)]
    else:
        cut = False
    out = reduce(lambda a, b: a.join(b, "repo", "left"), frames)
    for name in ("isolated_count", "entry_points_count", "total_cycles", "avg_cycle_length",
                 "max_cycle_length", "largest_scc_size"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)) if name in out.columns
                             else F.lit(0))
    return out.withColumn("total_imports", F.col("total_edges")).withColumn(
        "cycles_truncated", F.lit(cut))
