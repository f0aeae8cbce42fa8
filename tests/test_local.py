"""Searches inside tasks give what the staged rounds give; ties of the largest file."""

import random

import pytest

from srcgraph.operators import centrality, components, folders, local, spectral, traverse


def test_largest_file_ties_go_to_the_smaller_id(spark):
    rows = [("r", i, "module", f"src/p{i}.py", 5, 1) for i in (10, 9, 100)]
    n = spark.createDataFrame(
        rows, "repo STRING, id LONG, node_type STRING, file_path STRING, size_bytes LONG, line_count LONG")
    assert [r.largest_file_path for r in folders.largest_file(n).collect()] == ["src/p9.py"]


def _graph(spark, seed):
    pick = random.Random(seed)
    nodes, edges = [], []
    for repo, count, links in (("a", 12, 15), ("b", 6, 4), ("c", 1, 0)):
        names = [f"{repo}{i:02d}" for i in range(count)]
        nodes += [(repo, x, "module") for x in names]
        edges += [(repo, pick.choice(names), pick.choice(names)) for _ in range(links)]
    edges += edges[:3]
    return (spark.createDataFrame(nodes, "repo STRING, id STRING, node_type STRING"),
            spark.createDataFrame(edges, "repo STRING, source STRING, target STRING"))


OPERATORS = {
    "k_hop": lambda n, e: traverse.k_hop(e, n.select("repo", "id")),
    "k_hop_out": lambda n, e: traverse.k_hop(e, n.select("repo", "id"), 2, "out"),
    "max_depth": traverse.max_depth,
    "node_depth": traverse.node_depth,
    "closeness": centrality.closeness,
    "betweenness": centrality.betweenness,
    "pivots": lambda n, e: centrality.betweenness(n, e, k=4),
    "wcc": components.wcc,
    "pagerank": lambda n, e: spectral.pagerank(n, e, alpha=0.3, tol=1e-3),
    "paths": lambda n, e: traverse.shortest_paths(e, n.where("id LIKE '%5'"), n, 2),
}


def _rows(df):
    return sorted(tuple(round(v, 10) if isinstance(v, float) else v for v in r)
                  for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_in_task_equals_staged_rounds(spark, monkeypatch, name):
    n, e = _graph(spark, 7)
    monkeypatch.setattr(local, "SLOTS", 64)  # several blocks
    monkeypatch.setattr(local, "ROWS", 50)
    inside = _rows(OPERATORS[name](n, e))
    monkeypatch.setattr(local, "IN_TASK", 0)
    monkeypatch.setattr(local, "IN_TASK", 20)  # one repository beyond, two within
    assert inside == _rows(OPERATORS[name](n, e)) and inside


@pytest.mark.parametrize("name", ["k_hop", "node_depth", "betweenness", "wcc", "pagerank", "paths"])
def test_jobs_do_not_grow_with_the_length_of_a_chain(spark, name):
    ids = [f"n{i:03d}5" for i in range(60)]
    n = spark.createDataFrame([("r", i, "module") for i in ids], "repo STRING, id STRING, node_type STRING")
    e = spark.createDataFrame([("r", a, b) for a, b in zip(ids, ids[1:])], "repo STRING, source STRING, target STRING")
    group = f"chain-{name}"
    spark.sparkContext.setJobGroup(group, group)
    assert OPERATORS[name](n, e).count()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(jobs) < 40


def test_report_and_strong_components_in_tasks_equal_staged_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    from srcgraph.operators import compare, cycles, metrics
    n, e = _graph(spark, 11)
    n = n.withColumn("node_type", F.when(F.col("id").endswith("3"), "external").otherwise("module"))
    rank = n.select("repo", "id", F.lit(0.1).alias("pagerank"))
    work = {
        "full": lambda: metrics.metrics_report(n, e, "full", rank), "scc": lambda: components.scc(n, e),
        "shape": lambda: compare.graph_shape(n, e), "cycles": lambda: cycles.simple_cycles(n, e)[0]}
    inside = {k: sorted(map(str, f().collect())) for k, f in work.items()}
    kinds = {k: sorted(f().dtypes) for k, f in work.items()}
    monkeypatch.setattr(local, "IN_TASK", 20)
    assert inside == {k: sorted(map(str, f().collect())) for k, f in work.items()}
    assert kinds == {k: sorted(f().dtypes) for k, f in work.items()}
    assert inside["cycles"]


def test_strong_components_take_few_jobs(spark):
    ids = [f"n{i:03d}" for i in range(60)]
    n = spark.createDataFrame([("r", i) for i in ids], "repo STRING, id STRING")
    e = spark.createDataFrame([("r", a, b) for a, b in zip(ids, [*ids[1:], ids[30]])],
                              "repo STRING, source STRING, target STRING")
    spark.sparkContext.setJobGroup("strong", "strong")
    got = components.scc(n, e).where("scc <> id").count()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("strong")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert got == 29 and len(jobs) < 20
