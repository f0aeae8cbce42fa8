"""PageRank and eigenvector centrality as staged rounds.

A round joins the edges with the state once and merges contributions and
carried state by one aggregation, so hot targets are combined on the map side.
Every repo stops on its own test: a converged repo is carried unchanged.
Eigenvector rounds of a repo that fits one task all run there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.operators import local
from srcgraph.stage import Stage


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    alpha: float = 0.85,
    max_iter: int = 100,
    tol: float | None = 1e-6,
) -> DataFrame:
    """``repo, id, pagerank`` with uniform teleport and uniform dangling mass.

    A repo is final once the summed absolute change is below N * tol.  A repo that is not
    within ``max_iter`` rounds (at this damping the change shrinks by ``alpha`` a round)
    raises; ``tol=None`` runs exactly ``max_iter`` rounds.
    """
    stage = Stage(edges.sparkSession, "pagerank")
    got, large = local.by_repo(nodes, edges, local.ranks(alpha, max_iter, tol),
                               "id, pagerank double, done boolean")
    got, seen = stage.save(got, open=F.sum((~F.col("done")).cast("long")))
    if seen["open"]:
        raise ValueError(f"page rank has not converged in {max_iter} rounds")
    got = got.select("repo", "id", "pagerank")
    if large is None:
        return got
    return got.unionByName(_staged_ranks(
        local.only(nodes, large), local.only(edges, large), alpha, max_iter, tol, stage))


def _staged_ranks(
    nodes: DataFrame, edges: DataFrame, alpha: float, max_iter: int, tol: float | None, stage: Stage,
) -> DataFrame:
    """``repo, id, pagerank`` by one staged table a round."""
    links = edges.select("repo", "source", "target").distinct()
    out = links.groupBy("repo", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    size = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    state, _ = stage.save(
        nodes.select("repo", "id").join(out, ["repo", "id"], "left").join(size, "repo")
        .select("repo", "id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"),
                (F.lit(1.0) / F.col("n")).alias("rank"), F.lit(None).cast("double").alias("err"))
    )
    schema = state.schema
    links, _ = stage.save(links)
    small = F.lit(False) if tol is None else F.col("err") < F.col("n") * F.lit(tol or 0.0)
    stats = None
    for i in range(max_iter + 1):
        stats = state.groupBy("repo").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("deg") == 0, F.col("rank")).otherwise(0.0)).alias("loose"),
            F.sum("err").alias("err"),
        ).select("repo", "n", "loose", F.coalesce(small, F.lit(False)).alias("done"))
        if i == max_iter:
            break
        moved = links.join(
            state.where("deg > 0").select("repo", F.col("id").alias("source"),
                                          (F.col("rank") / F.col("deg")).alias("part")),
            ["repo", "source"],
        ).select("repo", F.col("target").alias("id"), "part", F.lit(0).cast("long").alias("deg"),
                 F.lit(0.0).alias("rank"))
        kept = state.select("repo", "id", F.lit(0.0).alias("part"), "deg", "rank")
        merged = moved.unionByName(kept).groupBy("repo", "id").agg(
            F.sum("part").alias("part"), F.max("deg").alias("deg"), F.max("rank").alias("rank"))
        fresh = F.when(F.col("done"), F.col("rank")).otherwise(
            alpha * (F.col("part") + F.col("loose") / F.col("n")) + (1.0 - alpha) / F.col("n"))
        step = merged.join(stats, "repo").select(
            "repo", "id", "deg", fresh.alias("fresh"), "rank", "done")
        old = state
        state, got = stage.save(
            step.select("repo", "id", "deg", F.col("fresh").alias("rank"),
                        F.abs(F.col("fresh") - F.col("rank")).alias("err"), "done"),
            schema, open=F.sum((~F.col("done")).cast("long")),
        )
        stage.drop(old)
        if not got["open"]:
            return state.select("repo", "id", F.col("rank").alias("pagerank"))
    if tol is not None and stats.where("NOT done").take(1):
        raise ValueError(f"page rank has not converged in {max_iter} rounds")
    return state.select("repo", "id", F.col("rank").alias("pagerank"))


#: Nodes and edges of a repo up to which one task runs all its eigenvector rounds.
IN_TASK = 1_000_000


def _power_rounds(max_iter: int, tol: float | None):
    """Cogroup function: all rounds of one repo."""
    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        index = pd.Index(n["id"])
        s, t = index.get_indexer(e["source"]), index.get_indexer(e["target"])
        x = np.full(len(n), 1.0 / max(1, len(n)))
        done = False
        for _ in range(max_iter):
            y = x + np.bincount(s, x[t], len(x))
            y /= np.sqrt((y * y).sum()) or 1.0
            done = tol is not None and np.abs(y - x).sum() < len(x) * tol
            x = y
            if done:
                break
        return pd.DataFrame({"repo": n["repo"], "id": n["id"], "eigenvector": x,
                             "converged": pd.array([None if tol is None else done] * len(n), dtype="boolean")})
    return run


def eigenvector(
    nodes: DataFrame,
    edges: DataFrame,
    max_iter: int = 5000,
    tol: float | None = 1e-6,
    in_task: int = IN_TASK,
) -> DataFrame:
    """``repo, id, eigenvector, converged``: shifted power iteration.

    x'[importer] = x[importer] + sum of x[imported], scaled to length 1.  The values of a
    repo that is not final after ``max_iter`` rounds are those of the last round, with
    ``converged`` false.  ``tol=None`` runs exactly ``max_iter`` rounds.

    Sparse graphs take hundreds of rounds, so a repo of at most ``in_task`` nodes and edges runs
    all of them in one task; only larger ones go by staged rounds.  The values are the same.
    """
    stage = Stage(edges.sparkSession, "eigenvector")
    links, _ = stage.save(edges.select("repo", "source", "target").distinct())
    parts = nodes.select("repo").union(links.select("repo")).groupBy("repo").agg(
        F.count(F.lit(1)).alias("c")).select("repo", (F.col("c") > in_task).alias("large"))
    parts, got = stage.save(parts, large=F.sum(F.col("large").cast("long")))
    few = parts.where("NOT large").select("repo")
    small = nodes.select("repo", "id").join(few, "repo", "left_semi").groupBy("repo").cogroup(
        links.join(few, "repo", "left_semi").groupBy("repo")).applyInPandas(
        _power_rounds(max_iter, tol),
        f"repo {nodes.schema['repo'].dataType.simpleString()}, id {nodes.schema['id'].dataType.simpleString()}, "
        "eigenvector double, converged boolean")
    if not got["large"]:
        return small
    many = parts.where("large").select("repo")
    return small.union(_staged_rounds(
        nodes.join(many, "repo", "left_semi"), links.join(many, "repo", "left_semi"), max_iter, tol, stage))


def _staged_rounds(nodes: DataFrame, links: DataFrame, max_iter: int, tol: float | None, stage: Stage) -> DataFrame:
    """``repo, id, eigenvector, converged`` by one staged table a round."""
    links, _ = stage.save(links)
    size = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    # y is the value before scaling, x the scaled value of the round before
    start = F.lit(1.0) / F.col("n")
    state, _ = stage.save(
        nodes.select("repo", "id").join(size, "repo")
        .select("repo", "id", start.alias("y"), F.lit(None).cast("double").alias("x")))
    schema = state.schema

    def scaled(s: DataFrame) -> DataFrame:
        """Unit-length values and whether the repo has converged."""
        norm = s.groupBy("repo").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        first = F.col("x").isNull()  # the start vector is used as it is
        now = s.join(norm, "repo").select("repo", "id", "x", F.when(
            first, F.col("y")).otherwise(F.col("y") / F.when(F.col("norm") == 0, 1.0)
                                         .otherwise(F.col("norm"))).alias("now"))
        small = F.lit(False) if tol is None else (
            F.sum(F.abs(F.col("now") - F.col("x"))) < F.count(F.lit(1)) * F.lit(tol))
        done = now.groupBy("repo").agg(F.coalesce(small, F.lit(False)).alias("done"))
        return now.join(done, "repo").select("repo", "id", F.col("now").alias("x"), "done")

    for _ in range(max_iter):
        at = scaled(state)
        gain = links.join(
            at.select("repo", F.col("id").alias("target"),
                      F.when(F.col("done"), 0.0).otherwise(F.col("x")).alias("part")),
            ["repo", "target"],
        ).select("repo", F.col("source").alias("id"), "part", F.lit(0.0).alias("x"),
                 F.lit(True).alias("done"))
        kept = at.select("repo", "id", F.lit(0.0).alias("part"), "x", "done")
        merged = gain.unionByName(kept).groupBy("repo", "id").agg(
            F.sum("part").alias("part"), F.max("x").alias("x"), F.min("done").alias("done"))
        old = state
        state, got = stage.save(
            merged.select("repo", "id", (F.col("x") + F.col("part")).alias("y"), "x", "done"),
            schema, open=F.sum((~F.col("done")).cast("long")))
        stage.drop(old)
        if not got["open"]:
            break
    last = scaled(state)
    if tol is None:
        return last.select("repo", "id", F.col("x").alias("eigenvector"),
                           F.lit(None).cast("boolean").alias("converged"))
    return last.select("repo", "id", F.col("x").alias("eigenvector"), F.col("done").alias("converged"))


def indegree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In-degree over the largest in-degree of the repo, 0 without edges."""
    indeg = edges.select("repo", "source", "target").distinct().groupBy(
        "repo", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    top = indeg.groupBy("repo").agg(F.max("deg").alias("top"))
    return (
        nodes.select("repo", "id").join(indeg, ["repo", "id"], "left").join(top, "repo", "left")
        .select("repo", "id",
                F.coalesce(F.col("deg") / F.col("top"), F.lit(0.0)).alias("indegree_centrality")))
