"""Rank queries against brute force on graphs that need many rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcgraph.operators import spectral
from srcgraph.plans import queries_graph
from srcgraph.plans.registry import QUERIES


def deep_graph():
    """A ring with a tail (slow) and a star (fast), as repo -> edges."""
    ring = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 1) for i in range(5, 40)] + [(40, 0), (3, 5)]
    return {"deep": ring, "star": [(100 + i, 100) for i in range(1, 9)]}


def brute(edges, follow, limit):
    ids = sorted({v for e in edges for v in e})
    at = {v: i for i, v in enumerate(ids)}
    n = len(ids)
    s, t = np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges])
    out = np.bincount(s, minlength=n)
    x = np.full(n, 1 / n)
    for _ in range(limit):
        if follow == "pagerank":
            y = 0.85 * (np.bincount(t, x[s] / out[s], n) + x[out == 0].sum() / n) + 0.15 / n
        else:
            y = x + np.bincount(s, x[t], n)
            y /= np.sqrt((y * y).sum())
        small = np.abs(y - x).sum() < n * 1e-6
        x = y
        if small:
            return dict(zip(ids, x, strict=True))
    raise AssertionError("not converged")


@pytest.fixture
def graph(spark):
    rows = [(r, a, b) for r, es in deep_graph().items() for a, b in es]
    edges = spark.createDataFrame(rows, "repo STRING, source LONG, target LONG")
    nodes = edges.select("repo", F.col("source").alias("id")).union(edges.select("repo", "target")).distinct()
    return nodes, edges


@pytest.mark.parametrize("name, limit", [("pagerank", 100), ("eigenvector", 5000)])
def test_queries_run_to_the_tolerance(graph, spark, monkeypatch, name, limit):
    monkeypatch.setattr(queries_graph, "parts", lambda *_: graph)
    want = {}
    for edges in deep_graph().values():
        want |= brute(edges, name, limit)
    got = {r.id: r[name] for r in QUERIES[name](spark, "unused").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_staged_rounds_equal_rounds_in_a_task(graph):
    nodes, edges = graph
    here = {(r.repo, r.id): r for r in spectral.eigenvector(nodes, edges, 6).collect()}
    for in_task in (0, 20):  # all repos, or only the larger one, by staged rounds
        there = {(r.repo, r.id): r for r in spectral.eigenvector(nodes, edges, 6, in_task=in_task).collect()}
        assert here.keys() == there.keys()
        assert all(abs(here[k].eigenvector - there[k].eigenvector) < 1e-9 for k in here)
        assert all(here[k].converged == there[k].converged for k in here)
