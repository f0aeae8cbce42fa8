"""Graph build: resolved imports to nodes and edges, and node enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.functions.paths import base_name, folder_path, normalize_file_key


def _order() -> Column:
    """Input order of an import row inside its repo."""
    return F.struct("source_file", "line_number", "pos")


def build_edges(resolved: DataFrame, go_package_nodes: bool = False) -> DataFrame:
    """One edge per (source, target): first import type, line numbers in order.

    ``go_package_nodes`` maps a Go source file to its folder, so that Go sources
    and targets are the same kind of node.
    """
    rows = resolved.withColumn("seq", _order())
    source = F.col("source_file")
    if go_package_nodes:
        here = folder_path("source_file")
        source = F.when(F.col("lang") == "go", F.when(here == "", ".").otherwise(here)
                        ).otherwise(source)
    # the list of one edge is bounded by the import lines of one file (or package)
    return (
        rows.groupBy("repo", source.alias("source"), "target")
        .agg(F.min_by("import_type", "seq").alias("import_type"),
             F.transform(F.array_sort(F.collect_list(F.struct("seq", "line_number"))),
                         lambda x: x["line_number"]).alias("line_numbers")))


def build_nodes(
    resolved: DataFrame, files: DataFrame | None = None, go_package_nodes: bool = False
) -> DataFrame:
    """Union of sources and targets; target attributes from its first occurrence.

    ``files`` adds every given file as a node, also those without imports.
    """
    seq = _order()
    source = F.col("source_file")
    if go_package_nodes:
        here = folder_path("source_file")
        source = F.when(F.col("lang") == "go", F.when(here == "", ".").otherwise(here)
                        ).otherwise(source)
    ends = resolved.select(
        "repo", F.explode(F.array(
            F.struct(source.alias("id"), F.lit("module").alias("node_type"),
                     F.lit(None).cast("string").alias("external_kind"), F.lit(0).alias("end"),
                     seq.alias("seq")),
            F.struct(F.col("target").alias("id"),
                     F.when(F.col("external_kind").isNull(), "module").otherwise("external")
                     .alias("node_type"),
                     F.col("external_kind"), F.lit(1).alias("end"), seq.alias("seq")),
        )).alias("e"))
    # a node that occurs as a source at its first row is a module
    first = F.struct("e.seq", "e.end")
    out = ends.groupBy("repo", F.col("e.id").alias("id")).agg(
        F.min_by(F.struct("e.node_type", "e.external_kind"), first).alias("a")
    ).select("repo", "id", "a.node_type", "a.external_kind")
    if files is not None:
        extra = files.select(
            "repo", F.col("path").alias("id"), F.lit("module").alias("node_type"),
            F.lit(None).cast("string").alias("external_kind"))
        out = out.unionByName(extra.join(out, ["repo", "id"], "left_anti"))
    return out


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, id, import_count, imported_by_count`` on distinct edges.

    One aggregation over both ends; the nodes enter it with zeros, so isolated
    nodes stay and no join is needed.
    """
    links = edges.select("repo", "source", "target").distinct()
    ends = links.select("repo", F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).cast("long").alias("o"),
                 F.lit(0).cast("long").alias("i")),
        F.struct(F.col("target").alias("id"), F.lit(0).cast("long").alias("o"),
                 F.lit(1).cast("long").alias("i")))).alias("e")).select("repo", "e.*")
    zero = nodes.select("repo", "id", F.lit(0).cast("long").alias("o"),
                        F.lit(0).cast("long").alias("i"))
    return ends.unionByName(zero).groupBy("repo", "id").agg(
        F.sum("o").alias("import_count"), F.sum("i").alias("imported_by_count"))


def instability(deg: DataFrame) -> DataFrame:
    """Add ``instability`` = out / (in + out), 0 when isolated."""
    total = F.col("import_count") + F.col("imported_by_count")
    return deg.withColumn("instability", F.when(
        total > 0, F.bround(F.col("import_count") / total, 4)).otherwise(0.0))


def labels(nodes: DataFrame) -> DataFrame:
    """Add ``label``: the id of an external, else the last path segment."""
    return nodes.withColumn("label", F.when(
        F.col("node_type") == "external", F.col("id")).otherwise(base_name("id")))


def external_ratio(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node: share of its imports that are external, 0 without imports."""
    kind = nodes.select("repo", F.col("id").alias("target"),
                        (F.col("node_type") == "external").cast("double").alias("ext"))
    share = (
        edges.select("repo", "source", "target").distinct().join(kind, ["repo", "target"])
        .groupBy("repo", F.col("source").alias("id"))
        .agg(F.bround(F.avg("ext"), 4).alias("external_ratio")))
    return nodes.select("repo", "id").join(share, ["repo", "id"], "left").select(
        "repo", "id", F.coalesce("external_ratio", F.lit(0.0)).alias("external_ratio"))


def line_count(content) -> Column:
    """Newlines, plus one for an unterminated last line."""
    c = F.col(content) if isinstance(content, str) else content
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + F.when(
        (c != "") & ~c.endswith("\n"), 1).otherwise(0)


def file_stats(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Size and line count of internal nodes."""
    stats = files.select(
        "repo", F.col("path").alias("id"), "size_bytes",
        line_count("content").cast("long").alias("line_count"))
    return nodes.where("node_type <> 'external'").select("repo", "id").join(
        stats, ["repo", "id"], "left")


def latest_commits(commits: DataFrame) -> DataFrame:
    """Latest commit per file: hash, subject, author, email, date."""
    fields = ["hash", "subject", "author_name", "author_email", "ts"]
    return commits.groupBy("repo", "path").agg(
        F.max_by(F.struct(*fields), F.struct("ts", "hash")).alias("c")
    ).select("repo", "path", *[F.col(f"c.{f}").alias(f) for f in fields])


def commit_join(nodes: DataFrame, commits: DataFrame) -> DataFrame:
    """``repo, id, commit_hash`` of internal nodes."""
    last = latest_commits(commits).select("repo", F.col("path").alias("id"),
                                          F.col("hash").alias("commit_hash"))
    return nodes.where("node_type <> 'external'").select("repo", "id").join(
        last, ["repo", "id"], "left")


def package_versions(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """Version of external packages by their top-level name: ``repo, id, version``."""
    wanted = nodes.where("external_kind = 'package'").select(
        "repo", "id", F.split_part("id", F.lit("."), F.lit(1)).alias("name"))
    return wanted.join(versions.select("name", "version"), "name").select("repo", "id", "version")


def capture_contents(
    nodes: DataFrame, files: DataFrame, max_files: int | None = None, max_chars: int | None = None,
) -> DataFrame:
    """Text of the node files of each repo; the caller may ask for fewer files or shorter texts."""
    have = files.select("repo", "path").join(
        nodes.where("node_type <> 'external'").select("repo", F.col("id").alias("path")),
        ["repo", "path"], "left_semi")
    chosen = have
    if max_files is not None:
        order = Window.partitionBy("repo").orderBy("path")
        chosen = have.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_files)
    text = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    return files.join(chosen.select("repo", "path"), ["repo", "path"], "left_semi").select(
        "repo", normalize_file_key("path").alias("key"),
        text.alias("content"))


def enrich_nodes(nodes: DataFrame, edges: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """Join score tables (``repo, id, value``) onto the nodes, missing values 0.

    All score tables are stacked and pivoted by one aggregation on (repo, id)
    instead of one join per score.
    """
    base = instability(degrees(nodes, edges))
    fields = {name: df.schema[name].dataType for name, df in scores.items()}
    parts = [
        df.select("repo", "id", *[
            (F.col(n) if n == name else F.lit(None).cast(t)).alias(n) for n, t in fields.items()])
        for name, df in scores.items()]
    out = labels(nodes).join(base, ["repo", "id"], "left")
    if parts:
        stacked = reduce(DataFrame.unionByName, parts)
        wide = stacked.groupBy("repo", "id").agg(*[F.max(n).alias(n) for n in fields])
        out = out.join(wide, ["repo", "id"], "left")
    nullable = {"version", "size_bytes", "line_count", "commit_hash", "external_kind"}
    for name in fields:
        if name not in nullable:
            out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    return out
