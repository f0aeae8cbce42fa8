"""Slices of a graph: externals, neighbours, search, lists, heat and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcgraph.functions.languages import language_of_ext
from srcgraph.functions.paths import extension
from srcgraph.operators import centrality, components, local, spectral
from srcgraph.operators.build import degrees


def external_usage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from internal nodes per external: ``repo, id, kind, usage, total_usage``."""
    outer = nodes.where("node_type = 'external'").select(
        "repo", "id", F.when(F.col("external_kind") == "stdlib", "stdlib").otherwise("package")
        .alias("kind"))
    inner = nodes.where("node_type <> 'external'").select("repo", F.col("id").alias("source"))
    used = edges.join(inner, ["repo", "source"], "left_semi").groupBy(
        "repo", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("usage"))
    rows = outer.join(used, ["repo", "id"], "left").withColumn(
        "usage", F.coalesce("usage", F.lit(0)))
    total = rows.groupBy("repo").agg(F.sum("usage").alias("total_usage"))
    return rows.join(total, "repo").select("repo", "id", "kind", "usage", "total_usage")


def neighbours(nodes: DataFrame, edges: DataFrame, asked: DataFrame | list) -> DataFrame:
    """Incoming and outgoing edges of the asked nodes (a list of ids, or ``repo, id``) with the peer's type."""
    cols = ["import_type", "line_numbers"] if "import_type" in edges.columns else []

    def side(end: str, direction: str, peer: str) -> DataFrame:
        if isinstance(asked, DataFrame):
            mine = edges.join(asked.select("repo", F.col("id").alias(end)), ["repo", end], "left_semi")
        else:
            mine = edges.where(F.col(end).isin(asked))
        return mine.select("repo", F.col(end).alias("id"), F.lit(direction).alias("direction"),
                           F.col(peer).alias("peer"), *cols)

    out, inn = side("source", "out", "target"), side("target", "in", "source")
    kind = nodes.select("repo", F.col("id").alias("peer"), F.col("node_type").alias("peer_type"))
    return out.unionByName(inn).join(kind, ["repo", "peer"], "left")


def matches(query: str) -> Column:
    """Case-insensitive substring test on label or path."""
    q = query.strip().lower()
    return F.lower("label").contains(q) | F.lower("file_path").contains(q)


def node_search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """First matching nodes of each repo by id."""
    order = Window.partitionBy("repo").orderBy("id")
    return nodes.where(matches(query)).withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= limit).drop("rank")


def node_list(
    nodes: DataFrame, query: str = "", stdlib: bool = False, packages: bool = False,
    sort: str = "label", ascending: bool = True,
) -> DataFrame:
    """Filtered node list in a chosen order, ties by label."""
    if sort not in ("label", "node_type", "import_count", "imported_by_count", "pagerank"):
        raise ValueError(f"cannot sort by {sort}")
    kind = F.coalesce("external_kind", F.lit("package"))
    shown = [k for k, on in (("stdlib", stdlib), ("package", packages)) if on]
    rows = nodes.where((F.col("node_type") != "external") | kind.isin(shown))
    if query.strip():
        rows = rows.where(matches(query))
    keys = [F.lower("label")] if sort == "label" else [F.col(sort), F.lower("label")]
    return rows.orderBy(*[k.asc() if ascending else k.desc() for k in keys])


def heat(nodes: DataFrame, metric: str) -> DataFrame:
    """Min-max scaled metric over the internal nodes of a repo, 0 without a range."""
    inner = nodes.where("node_type <> 'external'").select(
        "repo", "id", F.coalesce(F.col(metric).cast("double"), F.lit(0.0)).alias("v"))
    span = inner.groupBy("repo").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return inner.join(span, "repo").select("repo", "id", F.when(
        F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    ).otherwise(0.0).alias("heat"))


# fixed values: role and impact-text thresholds
HUB_IN_DEGREE = 5
HIGH_PAGERANK = 0.05
HIGH_BETWEENNESS = 0.02


def _n(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def standing(
    nodes: DataFrame, edges: DataFrame, pagerank: DataFrame | None = None, ranked: bool = False,
) -> DataFrame:
    """What ``module_roles`` and, with ranks, ``impact_text`` read of every node: ``repo, id, node_type, import_count,
    imported_by_count, cycle_count`` and ``pagerank, betweenness`` (null without ranks).

    ``ranked`` asks for ranks that are not given: ``spectral.pagerank`` is found in the same pass.

    ``cycle_count`` is 1 for nodes on a cycle of several nodes, else 0: such nodes share a strong component,
    so no cycle is listed.  ``node_type`` is external or module.
    """
    kind = F.coalesce(F.when(F.col("node_type") == "external", 5).when(F.col("node_type") != "external", 3), F.lit(1))
    rows = nodes.select("repo", "id", kind.alias("mark"))
    if pagerank is not None:
        rows = rows.unionByName(
            pagerank.select("repo", "id", F.lit(8).alias("mark"), F.col("pagerank").alias("value")), True)
    ranked = ranked or pagerank is not None
    got, large = local.by_repo(
        rows, edges, local.standing(ranked, pagerank is not None),
        "id, external boolean, import_count long, imported_by_count long, cycle_count long, pagerank double, "
        "delta double, n long, k long")
    # a node without a type is neither
    type_ = F.when(F.col("external"), "external").when(~F.col("external"), "module").alias("node_type")
    between = centrality.scaled() if ranked else F.lit(None).cast("double")
    got = got.select("repo", "id", type_, "import_count", "imported_by_count", "cycle_count", "pagerank",
                     between.alias("betweenness"))
    if large is None:
        return got
    nodes, edges = local.only(nodes, large), local.only(edges, large)
    members = components.members(nodes, edges, inner=True)
    rings = members.join(members.groupBy("repo", "label").count().where("count > 1"), ["repo", "label"]).select(
        "repo", "id", F.lit(1).cast("long").alias("cycle_count"))
    none = F.lit(None).cast("double")
    more = (
        nodes.select("repo", "id", (F.col("node_type") == "external").alias("external"))
        .join(degrees(nodes, edges), ["repo", "id"]).join(rings, ["repo", "id"], "left").na.fill(0, ["cycle_count"]))
    if not ranked:
        more = more.select("*", none.alias("pagerank"), none.alias("betweenness"))
    else:
        pagerank = spectral.pagerank(nodes, edges) if pagerank is None else pagerank
        more = more.join(pagerank.select("repo", "id", "pagerank"), ["repo", "id"], "left").na.fill(
            0.0, ["pagerank"]).join(centrality.betweenness(nodes, edges), ["repo", "id"])
    return got.unionByName(more.withColumn("node_type", type_).drop("external"))


def module_roles() -> Column:
    """Role names of a node as an array."""
    inner = F.col("node_type") != "external"
    return F.array_compact(F.array(
        F.when((_n("imported_by_count") == 0) & inner, "Entry point"),
        F.when((_n("import_count") == 0) & inner, "Leaf"),
        F.when(_n("cycle_count") > 0, "In cycles"),
        F.when(_n("imported_by_count") >= HUB_IN_DEGREE, "Hub")))


def impact_text() -> Column:
    """One-sentence impact description of an internal node, else null."""
    cyc, pr = _n("cycle_count") > 0, _n("pagerank") >= HIGH_PAGERANK
    bet = _n("betweenness") >= HIGH_BETWEENNESS
    leaf, entry = _n("import_count") == 0, _n("imported_by_count") == 0
    return (
        F.when(F.col("node_type") == "external", F.lit(None).cast("string"))
        .when(leaf & entry, "Isolated — no imports or dependents.")
        .when(leaf, "Leaf — no outgoing imports.")
        .when(entry, "Entry point — nothing imports this.")
        .when(cyc & pr, "In cycles and high impact — refactor may affect many modules.")
        .when(cyc, "Participates in circular dependencies.")
        .when(pr & bet, "High impact and bridge — many depend on this; lies on key paths.")
        .when(pr, "High impact — many modules depend on this.")
        .when(bet, "Bridge — lies on many shortest paths between modules."))


def nodes_by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


def nodes_by_language(nodes: DataFrame, language: str) -> DataFrame:
    """Internal nodes of a language, derived from the file extension."""
    return nodes.where("node_type <> 'external'").where(
        F.lower(language_of_ext(extension("file_path"))) == language.lower())


def top_nodes(nodes: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("repo").orderBy(F.col("pagerank").desc(), "id")
    return nodes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def node_by_id(nodes: DataFrame, node_id) -> DataFrame:
    return nodes.where(F.col("id") == F.lit(node_id))


def line_window(files: DataFrame, start: int, end: int, context: int = 0) -> DataFrame:
    """Lines ``[start-context, end+context]`` of each file, 1-based and clamped."""
    lines = F.split("content", "\n")
    count = F.size(lines) - F.when(F.col("content").endswith("\n") | (F.col("content") == ""), 1
                                   ).otherwise(0)
    lo = max(1, start - context)
    return files.select("repo", "path", count.alias("total_lines"),
                        F.regexp_replace(extension("path"), r"^\.", "").alias("language"),
                        F.posexplode(F.slice(lines, lo, end + context - lo + 1)).alias("i", "text")
                        ).withColumn("line_number", F.col("i") + lo).where(
        "line_number <= total_lines").drop("i")
