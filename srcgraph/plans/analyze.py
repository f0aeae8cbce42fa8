"""Whole-portfolio analysis: files to nodes, edges and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.operators import build, centrality, cycles, extract, metrics, resolve, spectral, traverse
from srcgraph.sources.configs import project_configs
from srcgraph.sources.files import filter_ignored
from srcgraph.stage import Stage


def graph_of(
    files: DataFrame, mode: str = "exact", patterns: list[str] | None = None,
    include_all_files: bool = False, go_package_nodes: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and resolved import rows of the given files."""
    kept = filter_ignored(files, patterns)
    imports = extract.extract_imports(kept, mode)
    resolved = resolve.resolve_imports(imports, kept, project_configs(kept))
    resolved, _ = Stage(files.sparkSession, "resolved").save(resolved)
    listed = kept.where(F.col("ext").isin(extract.supported_extensions()))
    nodes = build.build_nodes(resolved, listed if include_all_files else None, go_package_nodes)
    return nodes, build.build_edges(resolved, go_package_nodes), resolved


def analyze(
    files: DataFrame, mode: str = "exact", level: str = "full", patterns: list[str] | None = None,
    commits: DataFrame | None = None, versions: DataFrame | None = None,
    max_cycle_length: int | None = None, include_all_files: bool = False, max_rounds: int = 5000,
) -> dict[str, DataFrame]:
    """``nodes, edges, metrics, warnings`` of a portfolio in one run.

    ``level='light'`` leaves out cycles, hubs and the score columns that need
    them.  ``max_rounds`` bounds the eigenvector rounds.  The loops run on compact numeric ids and are mapped back at the end.
    """
    spark = files.sparkSession
    stage = Stage(spark, "analyze")
    nodes, edges, _ = graph_of(files, mode, patterns, include_all_files)
    nodes, _ = stage.save(build.labels(nodes).withColumn("file_path", F.col("id")))
    edges, _ = stage.save(edges)
    ids, small_nodes, small_edges = compact_ids(stage, nodes, edges)
    scores = {"depth": traverse.node_depth(small_nodes, small_edges)}
    rank, rings = None, None
    if level == "full":
        rank = spectral.pagerank(small_nodes, small_edges)
        rings, _ = cycles.simple_cycles(small_nodes, small_edges, max_cycle_length)
        scores |= {
            "pagerank": rank, "betweenness": centrality.betweenness(small_nodes, small_edges),
            "closeness": centrality.closeness(small_nodes, small_edges),
            "eigenvector": spectral.eigenvector(small_nodes, small_edges, max_rounds),
            "cycle_count": cycles.cycle_participation(small_nodes, rings),
        }
    back = lambda df: df.withColumnRenamed("id", "vid").join(ids, ["repo", "vid"]).drop("vid")
    scores = {name: back(df) for name, df in scores.items()}
    scores["external_ratio"] = build.external_ratio(nodes, edges)
    stats = build.file_stats(nodes, files)
    scores["size_bytes"], scores["line_count"] = stats, stats
    if commits is not None:
        scores["commit_hash"] = build.commit_join(nodes, commits)
    if versions is not None:
        scores["version"] = build.package_versions(nodes, versions)
    return {
        "nodes": build.enrich_nodes(nodes, edges, scores), "edges": edges,
        "metrics": metrics.metrics_report(
            nodes, edges, level, None if rank is None else back(rank), max_cycle_length),
        "warnings": extract.parse_warnings(filter_ignored(files, patterns), mode),
    }


def compact_ids(stage: Stage, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numeric node ids in id order, written once, so loops shuffle 8-byte keys.

    The nodes are range-partitioned and sorted, so the numbers follow the order
    of (repo, id) and smallest-id rules give the same answer on both forms.
    """
    ordered = nodes.repartitionByRange("repo", "id").sortWithinPartitions("repo", "id").withColumn(
        "vid", F.monotonically_increasing_id())
    full, _ = stage.save(ordered.select("repo", "id", "vid", "node_type"))
    ids = full.select("repo", "id", "vid")
    links, _ = stage.save(
        edges.select("repo", "source", "target")
        .join(ids.select("repo", F.col("id").alias("source"), F.col("vid").alias("s")),
              ["repo", "source"])
        .join(ids.select("repo", F.col("id").alias("target"), F.col("vid").alias("t")),
              ["repo", "target"])
        .select("repo", F.col("s").alias("source"), F.col("t").alias("target")))
    return ids, full.select("repo", F.col("vid").alias("id"), "node_type"), links
