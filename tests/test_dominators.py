"""Dominator trees and removal against brute force on random graphs with cycles."""

import random

from srcgraph.operators import impact, local
from srcgraph.operators.dominators import dominators


def _reach(pairs, seeds, without=None):
    seen = {s for s in seeds if s != without}
    todo = list(seen)
    while todo:
        at = todo.pop()
        for a, b in pairs:
            if a == at and b != without and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def _random_graphs(count, seed):
    rng = random.Random(seed)
    for g in range(count):
        size = rng.randint(2, 14)
        pairs = {(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randint(1, size * 2))}
        yield f"g{g}", size, sorted(pairs)


def test_dominators_by_brute_force(spark):
    graphs = list(_random_graphs(60, 5))
    arcs = spark.createDataFrame([(g, a, True, b, True) for g, _, pairs in graphs for a, b in pairs],
                                 "repo STRING, source INT, source_counted BOOLEAN, id INT, counted BOOLEAN")
    roots = spark.createDataFrame([(g, r, True) for g, size, _ in graphs for r in {0, size // 2}],
                                  "repo STRING, id INT, counted BOOLEAN")
    got = {(r.repo, r.id): set(r.path) for r in dominators(arcs, roots).collect()}
    want = {}
    for g, size, pairs in graphs:
        seeds = {0, size // 2}
        for v in _reach(pairs, seeds):
            want[g, v] = {d for d in range(size) if d == v or v not in _reach(pairs, seeds, d)}
    assert got == want


def test_dominators_of_a_graph_that_moves_for_many_rounds(spark):
    # every rung can be passed on either side, and one late arc enters from the root
    pairs = [(0, 1), (0, 2)] + [(i, i + 2) for i in range(1, 40)] + [(i, i + 1) for i in range(3, 40, 4)]
    pairs += [(41, 5), (0, 40)]
    arcs = spark.createDataFrame([("r", a, True, b, True) for a, b in pairs],
                                 "repo STRING, source INT, source_counted BOOLEAN, id INT, counted BOOLEAN")
    roots = spark.createDataFrame([("r", 0, True)], "repo STRING, id INT, counted BOOLEAN")
    got = {r.id: set(r.path) for r in dominators(arcs, roots).collect()}
    assert got == {v: {d for d in range(42) if d == v or v not in _reach(pairs, {0}, d)}
                   for v in _reach(pairs, {0})}


def test_removal_on_random_graphs(spark):
    graphs = list(_random_graphs(80, 11))
    outside = {(g, v) for g, size, _ in graphs for v in range(size) if v % 5 == 4}
    nodes = spark.createDataFrame(
        [(g, v, "external" if (g, v) in outside else "module") for g, size, _ in graphs for v in range(size)],
        "repo STRING, id INT, node_type STRING")
    edges = spark.createDataFrame([(g, a, b) for g, _, pairs in graphs for a, b in pairs],
                                  "repo STRING, source INT, target INT")
    for strict in (False, True):
        want = set()
        for g, size, pairs in graphs:
            pool = {v for v in range(size) if not (strict and (g, v) in outside)}
            for gone in range(size):
                rest = [p for p in pairs if gone not in p]
                seen = _reach(rest, {v for v in pool if v != gone and all(b != v for _, b in rest)})
                want |= {(g, gone, "orphaned_file", v) for v in pool - seen - {gone}}
                want |= {(g, gone, "broken_import", a) for a, b in pairs if b == gone}
        got = impact.simulate_removal(nodes, edges, nodes.select("repo", "id"), strict).collect()
        assert len(got) == len(want)
        assert {tuple(r) for r in got} == want


def test_orphans_stand_once(spark):
    nodes = spark.createDataFrame([("r", c) for c in "abcuv"], "repo STRING, id STRING").selectExpr(
        "*", "'module' AS node_type")
    edges = spark.createDataFrame([("r", *p) for p in ["ab", "ac", "bc", "cb", "uv", "vu"]],
                                  "repo STRING, source STRING, target STRING")
    got = {(r.gone, r.id, r.lost) for r in impact.removal_orphans(nodes, edges).collect()}
    assert got == {("a", "b", False), ("a", "c", False), (None, "u", True), (None, "v", True),
                   ("u", "v", True), ("v", "u", True)}


def test_removal_in_tasks_equals_staged_rounds_and_takes_few_jobs(spark, monkeypatch):
    graphs = list(_random_graphs(30, 3))
    chain = [(i, i + 1) for i in range(40)]
    nodes = spark.createDataFrame(
        [(g, v, "external" if v % 5 == 4 else "module") for g, size, _ in [*graphs, ("chain", 41, chain)]
         for v in range(size)], "repo STRING, id INT, node_type STRING")
    edges = spark.createDataFrame([(g, a, b) for g, _, pairs in [*graphs, ("chain", 41, chain)] for a, b in pairs],
                                  "repo STRING, source INT, target INT")
    spark.sparkContext.setJobGroup("removal", "removal")
    inside = sorted(map(str, impact.removal_orphans(nodes, edges, True).collect()))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("removal")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(jobs) < 20
    monkeypatch.setattr(local, "IN_TASK", 25)  # the chain and the larger graphs beyond, the others within
    assert inside == sorted(map(str, impact.removal_orphans(nodes, edges, True).collect()))
