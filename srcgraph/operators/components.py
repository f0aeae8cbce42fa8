"""Strongly and weakly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.operators import local
from srcgraph.operators.traverse import reverse
from srcgraph.stage import Stage


def _spread_min(stage: Stage, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest label that reaches each node: ``repo, id, label``.

    Only labels that changed in the last round travel, and a node also takes
    the label of its label (which reaches it too), so long chains need few rounds.
    """
    state, _ = stage.save(labels.withColumn("hot", F.lit(True)))
    while True:
        sent = (
            state.where("hot").select("repo", F.col("id").alias("source"), "label")
            .join(links, ["repo", "source"])
            .select("repo", F.col("target").alias("id"), "label")
        )
        jump = (
            state.select("repo", "id", F.col("label").alias("via")).where("id <> via")
            .join(state.select("repo", F.col("id").alias("via"), "label").where("via <> label"),
                  ["repo", "via"])
            .select("repo", "id", "label")
        )
        offers = sent.unionByName(jump).select("repo", "id", F.col("label").alias("offer"),
                                               F.lit(None).cast(state.schema["label"].dataType)
                                               .alias("label"))
        own = state.select("repo", "id", F.lit(None).cast(state.schema["label"].dataType)
                           .alias("offer"), "label")
        merged = offers.unionByName(own).groupBy("repo", "id").agg(
            F.min("offer").alias("offer"), F.min("label").alias("label"))
        old = state
        state, got = stage.save(
            merged.where("label IS NOT NULL").select(
                "repo", "id", F.least("label", "offer").alias("label"),
                F.coalesce(F.col("offer") < F.col("label"), F.lit(False)).alias("hot")),
            hot=F.sum(F.col("hot").cast("long")))
        stage.drop(old)
        if not got["hot"]:
            return state.select("repo", "id", "label")


def _spread_both(stage: Stage, links: DataFrame) -> DataFrame:
    """Smallest ids that reach each node (``f``) and that it reaches (``b``).

    Both directions move in the same round.  A node also takes the label of its
    label, so that the rounds do not grow with the length of chains alone.
    """
    live = (
        links.select("repo", F.col("source").alias("id"))
        .unionByName(links.select("repo", F.col("target").alias("id"))).distinct())
    state, _ = stage.save(live.select("repo", "id", F.col("id").alias("f"), F.col("id").alias("b"),
                                      F.lit(True).alias("hot")))
    kind = state.schema["id"].dataType
    none = F.lit(None).cast(kind)

    def offer(df: DataFrame, f, b) -> DataFrame:
        return df.select("repo", "id", f.alias("of"), b.alias("ob"), none.alias("f"), none.alias("b"))

    while True:
        hot = state.where("hot")
        down = hot.select("repo", F.col("id").alias("source"), "f").join(
            links, ["repo", "source"]).withColumnRenamed("target", "id")
        up = hot.select("repo", F.col("id").alias("target"), "b").join(
            links, ["repo", "target"]).withColumnRenamed("source", "id")
        far_f = state.where("f <> id").select("repo", "id", F.col("f").alias("via")).join(
            state.where("f <> id").select("repo", F.col("id").alias("via"), "f"), ["repo", "via"])
        far_b = state.where("b <> id").select("repo", "id", F.col("b").alias("via")).join(
            state.where("b <> id").select("repo", F.col("id").alias("via"), "b"), ["repo", "via"])
        rows = (
            state.select("repo", "id", none.alias("of"), none.alias("ob"), "f", "b")
            .unionByName(offer(down, F.col("f"), none)).unionByName(offer(up, none, F.col("b")))
            .unionByName(offer(far_f, F.col("f"), none)).unionByName(offer(far_b, none, F.col("b"))))
        merged = rows.groupBy("repo", "id").agg(*[F.min(c).alias(c) for c in ("of", "ob", "f", "b")])
        less = lambda o, c: F.coalesce(F.col(o) < F.col(c), F.lit(False))
        old = state
        state, got = stage.save(
            merged.select("repo", "id", F.least("of", "f").alias("f"), F.least("ob", "b").alias("b"),
                          (less("of", "f") | less("ob", "b")).alias("hot")),
            hot=F.sum(F.col("hot").cast("long")))
        stage.drop(old)
        if not got["hot"]:
            return state.select("repo", "id", "f", "b")


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, id, scc``: the label is the smallest id of the component."""
    return nodes.select("repo", "id").join(members(nodes, edges), ["repo", "id"], "left").select(
        "repo", "id", F.coalesce("label", "id").alias("scc"))


def members(nodes: DataFrame, edges: DataFrame, inner: bool = False) -> DataFrame:
    """``repo, id, label`` of the nodes in strong components of more than one node, as a table.

    ``inner`` follows only edges between ``nodes``.  Repositories that fit a task are answered there; nodes of
    others may stand alone under their own label.
    """
    stage = Stage(edges.sparkSession, "members")
    got, large = local.by_repo(nodes, edges, local.strong_components(inner), "id, label")
    if large is not None:
        nodes, edges = local.only(nodes, large), local.only(edges, large)
        more = _staged_members(_between(nodes, edges) if inner else edges)
        if more is not None:
            got = got.unionByName(more.join(nodes.select("repo", "id"), ["repo", "id"], "left_semi"))
    return stage.save(got)[0]


def _staged_members(edges: DataFrame) -> DataFrame | None:
    """``repo, id, label`` by staged rounds, None without cycles.

    Rounds of: drop edges whose source has no importer or whose target imports
    nothing (they lie on no cycle); find for each node the smallest id that reaches
    it and the smallest it reaches.  Where both agree the component is known; other
    components lie inside groups of equal pairs, so only edges inside such a group go
    to the next round.
    """
    stage = Stage(edges.sparkSession, "scc")
    links = edges.select("repo", "source", "target").where("source <> target").distinct()
    links, got = stage.save(links, n=F.count(F.lit(1)))
    found: list[DataFrame] = []
    while got["n"]:
        links, got = _trim(stage, links, got["n"])
        if not got["n"]:
            break
        both = _spread_both(stage, links)
        found.append(both.where("f = b").select("repo", "id", F.col("f").alias("label")))
        rest = both.where("f <> b")
        tail = rest.select("repo", F.col("id").alias("source"), F.col("f").alias("fs"),
                           F.col("b").alias("bs"))
        head = rest.select("repo", F.col("id").alias("target"), F.col("f").alias("ft"),
                           F.col("b").alias("bt"))
        links, got = stage.save(
            links.join(tail, ["repo", "source"]).join(head, ["repo", "target"])
            .where("fs = ft AND bs = bt").select("repo", "source", "target"),
            n=F.count(F.lit(1)))
    if not found:
        return None
    labels = found[0]
    for more in found[1:]:
        labels = labels.unionByName(more)
    return labels


def _trim(stage: Stage, links: DataFrame, n: int) -> tuple[DataFrame, dict]:
    """Peel edges off the acyclic fringe until a round removes next to nothing."""
    while True:
        has_in = links.select("repo", F.col("target").alias("source")).distinct()
        has_out = links.select("repo", F.col("source").alias("target")).distinct()
        old = links
        links, got = stage.save(
            links.join(has_in, ["repo", "source"], "left_semi")
            .join(has_out, ["repo", "target"], "left_semi"),
            n=F.count(F.lit(1)))
        stage.drop(old)
        if not got["n"] or got["n"] > 0.98 * n:
            return links, got
        n = got["n"]


def wcc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weakly connected components: ``repo, id, component`` (smallest id)."""
    got, large = local.by_repo(nodes, edges, local.weak_components, "id, component")
    if large is None:
        return got
    nodes, edges = local.only(nodes, large), local.only(edges, large)
    stage = Stage(edges.sparkSession, "wcc")
    both = edges.select("repo", "source", "target").unionByName(reverse(edges))
    links, _ = stage.save(both.where("source <> target").distinct())
    labels = _spread_min(
        stage, nodes.select("repo", "id").withColumn("label", F.col("id")), links)
    return got.unionByName(labels.withColumnRenamed("label", "component"))


def largest_scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, largest_scc_size`` over internal nodes: 1 when acyclic, 0 when empty."""
    inner = nodes.where("node_type <> 'external'")
    sizes = members(inner, edges, inner=True).groupBy("repo", "label").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.unionByName(inner.select("repo").distinct().select(
        "repo", F.lit(None).cast(nodes.schema["id"].dataType).alias("label"), F.lit(1).cast("long").alias("size"))
    ).groupBy("repo").agg(F.max("size").alias("size"))
    return nodes.select("repo").distinct().join(top, "repo", "left").select(
        "repo", F.coalesce("size", F.lit(0)).alias("largest_scc_size"))


def internal(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sub-graph of nodes that are not external."""
    inner = nodes.where("node_type <> 'external'")
    return inner, _between(inner, edges)


def _between(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("repo", "id")
    return (
        edges.join(ids.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi")
        .join(ids.withColumnRenamed("id", "target"), ["repo", "target"], "left_semi"))
