"""Graph operators on small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from srcgraph.operators import (
    centrality, components, cycles, explore, impact, metrics, spectral, traverse)


def graph(spark, *repos):
    nodes, edges = [], []
    for repo, names, pairs in repos:
        nodes += [(repo, n, "external" if n.startswith("x:") else "module") for n in names]
        edges += [(repo, a, b) for a, b in pairs]
    return (spark.createDataFrame(nodes, "repo STRING, id STRING, node_type STRING"),
            spark.createDataFrame(edges, "repo STRING, source STRING, target STRING"))


CHAIN = ("chain", ["a.py", "b.py", "c.py"], [("a.py", "b.py"), ("b.py", "c.py")])
RING = ("ring", ["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")])
SEVEN = ("seven", list("ABCDEFG"),
         [("A", "B"), ("B", "C"), ("C", "D"), ("A", "E"), ("F", "B")])
RANKS = {"A": .05, "B": .25, "C": .20, "D": .15, "E": .10, "F": .05, "G": .02}


def table(df, *keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_chain_and_ring_in_one_run(spark):
    n, e = graph(spark, CHAIN, RING)
    rank = table(spectral.pagerank(n, e), "repo", "id", value="pagerank")
    assert sum(v for k, v in rank.items() if k[0] == "chain") == pytest.approx(1)
    assert rank["chain", "c.py"] > rank["chain", "b.py"] > rank["chain", "a.py"]
    assert all(rank["ring", i] == pytest.approx(1 / 3) for i in "abc")
    depth = table(traverse.node_depth(n, e), "repo", "id", value="depth")
    assert [depth["chain", i] for i in ("a.py", "b.py", "c.py")] == [0, 1, 2]
    assert [depth["ring", i] for i in "abc"] == [0, 0, 0]
    assert table(traverse.max_depth(n, e), "repo", value="max_import_depth") == {
        ("chain",): 2, ("ring",): 0}
    bet = table(centrality.betweenness(n, e), "repo", "id", value="betweenness")
    assert bet["chain", "b.py"] == pytest.approx(0.5) and bet["chain", "a.py"] == 0
    # on a ring of 3 each node lies on one of two paths
    assert bet["ring", "a"] == pytest.approx(0.5)
    close = table(centrality.closeness(n, e), "repo", "id", value="closeness")
    assert close["chain", "a.py"] == pytest.approx(2 / 3) and close["chain", "c.py"] == 0
    assert close["ring", "b"] == pytest.approx(2 / 3)
    parts = table(components.scc(n, e), "repo", "id", value="scc")
    assert {parts["ring", i] for i in "abc"} == {"a"} and parts["chain", "b.py"] == "b.py"
    assert table(components.largest_scc(n, e), "repo", value="largest_scc_size") == {
        ("chain",): 1, ("ring",): 3}
    rings, cut = cycles.simple_cycles(n, e)
    assert not cut and [r.cycle for r in rings.collect()] == [["a", "b", "c"]]
    count = table(cycles.cycle_participation(n, rings), "repo", "id", value="cycle_count")
    assert count["ring", "a"] == 1 and count["chain", "a.py"] == 0
    typed = e.withColumn("import_type", F.lit("module")).withColumn("line_numbers", F.array(F.lit(1)))
    detail = cycles.cycle_details(rings, typed).collect()
    assert len(detail) == 1 and len(detail[0].edges) == 3 and detail[0].severity == "high"
    assert cycles.cycle_warnings(rings).first().warning == "a → b → c"


def test_pagerank_matches_plain_iteration(spark):
    pairs = [(i, (i * 7 + 3) % 50) for i in range(50)] + [(i, i // 2) for i in range(2, 40)]
    pairs = sorted({p for p in pairs if p[0] != p[1] and p[0] % 9})
    n = spark.createDataFrame([("r", i, "module") for i in range(50)], "repo STRING, id INT, node_type STRING")
    e = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo STRING, source INT, target INT")
    x = [1 / 50] * 50
    outs = {i: [b for a, b in pairs if a == i] for i in range(50)}
    for _ in range(100):
        loose = sum(x[i] for i in range(50) if not outs[i])
        y = [0.15 / 50 + 0.85 * loose / 50] * 50
        for a, b in pairs:
            y[b] += 0.85 * x[a] / len(outs[a])
        err = sum(abs(p - q) for p, q in zip(x, y))
        x = y
        if err < 50 * 1e-6:
            break
    got = table(spectral.pagerank(n, e), "id", value="pagerank")
    assert all(got[i,] == pytest.approx(x[i], abs=1e-12) for i in range(50))


def test_eigenvector_matches_plain_iteration(spark):
    pairs = sorted({(i, (i + 1) % 12) for i in range(12)} | {(i, (i * 5 + 2) % 12) for i in range(12)})
    pairs = [p for p in pairs if p[0] != p[1]]
    n = spark.createDataFrame([("r", i, "module") for i in range(12)], "repo STRING, id INT, node_type STRING")
    e = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo STRING, source INT, target INT")
    x = [1 / 12] * 12
    for _ in range(60):
        y = list(x)
        for a, b in pairs:
            y[a] += x[b]
        norm = sum(v * v for v in y) ** 0.5
        y = [v / norm for v in y]
        err = sum(abs(p - q) for p, q in zip(x, y))
        x = y
        if err < 12 * 1e-4:
            break
    got = spectral.eigenvector(n, e, 60, 1e-4).collect()
    assert all(r.converged for r in got)
    assert all(r.eigenvector == pytest.approx(x[r.id], abs=1e-9) for r in got)


def test_many_origins_match_plain_search(spark):
    pairs = sorted({(i, (i * 7 + 3) % 150) for i in range(150)} | {(i, i // 3) for i in range(150)})
    n = spark.createDataFrame([("r", i, "module") for i in range(150)], "repo STRING, id INT, node_type STRING")
    e = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo STRING, source INT, target INT")
    outs = {i: [b for a, b in pairs if a == i] for i in range(150)}
    want = {}
    for i in range(150):
        dist, level = {i: 0}, [i]
        while level:
            level = sorted({b for a in level for b in outs[a]} - set(dist))
            dist |= {b: max(dist.values()) + 1 for b in level}
        total, r = sum(dist.values()), len(dist)
        want[i] = (r - 1) / total * (r - 1) / 149 if total else 0
    got = table(centrality.closeness(n, e), "id", value="closeness")
    assert all(got[i,] == pytest.approx(want[i]) for i in range(150))


def test_unconverged_is_told(spark):
    n, e = graph(spark, CHAIN)
    with pytest.raises(ValueError, match="converged"):
        spectral.pagerank(n, e, max_iter=1, tol=1e-12)
    got = spectral.eigenvector(n, e, max_iter=1, tol=1e-12).collect()
    assert {r.converged for r in got} == {False}


def test_empty(spark):
    n, e = graph(spark, ("r", [], []))
    assert spectral.pagerank(n, e).count() == 0
    assert components.scc(n, e).count() == 0
    assert cycles.simple_cycles(n, e)[0].count() == 0
    assert centrality.betweenness(n, e).count() == 0
    assert metrics.edge_counts(n, e).count() == 0


def test_scc_of_nested_rings(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7), (7, 8), (8, 6), (9, 1),
             (8, 10), (10, 11)]
    n = spark.createDataFrame([("r", i, "module") for i in range(1, 12)], "repo STRING, id INT, node_type STRING")
    e = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo STRING, source INT, target INT")
    got = table(components.scc(n, e), "id", value="scc")
    assert got == {(1,): 1, (2,): 1, (3,): 1, (4,): 4, (5,): 4, (6,): 6, (7,): 6, (8,): 6,
                   (9,): 9, (10,): 10, (11,): 11}
    assert {r.component for r in components.wcc(n, e).collect()} == {1}


def test_cycle_limit_is_reported(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "a")]
    n, e = graph(spark, ("r", list("abcd"), pairs))
    full, cut = cycles.simple_cycles(n, e)
    assert not cut and sorted(r.length for r in full.collect()) == [2, 4]
    short, cut = cycles.simple_cycles(n, e, 2)
    assert cut and [r.cycle for r in short.collect()] == [["a", "b"]]


def test_impact(spark):
    n, e = graph(spark, SEVEN)
    rank = spark.createDataFrame([("seven", k, v) for k, v in RANKS.items()],
                                 "repo STRING, id STRING, pagerank DOUBLE")
    asked = spark.createDataFrame([("seven", t) for t in ("D", "C", "B", "G", "UNKNOWN")],
                                  "repo STRING, id STRING")
    hit = impact.affected_files(n, e, asked, rank)
    dist = {}
    for r in hit.collect():
        dist.setdefault(r.target, {})[r.file_path] = r.distance
    assert dist == {"D": {"C": 1, "B": 2, "A": 3, "F": 3}, "C": {"B": 1, "A": 2, "F": 2},
                    "B": {"A": 1, "F": 1}}
    score = {r.target: (r.affected_count, r.impact_score, r.risk_level)
             for r in impact.impact_score(n, hit, asked, rank).collect()}
    assert score == {"D": (4, 57.1, "high"), "C": (3, 54.3, "high"), "B": (2, 47.1, "high"),
                     "G": (0, 4.0, "low"), "UNKNOWN": (0, 0.0, "low")}
    one = spark.createDataFrame([("seven", "C")], "repo STRING, id STRING")
    assert {r.id for r in traverse.k_hop(e, one, 1).collect()} == {"B"}
    assert {r.id for r in traverse.k_hop(e, one, 2).collect()} == {"A", "B", "F"}
    d = spark.createDataFrame([("seven", "D")], "repo STRING, id STRING")
    chains = sorted(r.chain for r in impact.dependency_chains(n, e, d).collect())
    assert chains == [["A", "B", "C", "D"], ["F", "B", "C", "D"]]
    gone = impact.simulate_removal(n, e, asked)
    broken = {}
    for r in gone.collect():
        assert r.kind == "broken_import"
        broken.setdefault(r.target, set()).add(r.id)
    assert broken == {"B": {"A", "F"}, "D": {"C"}, "C": {"B"}}


def test_removal_orphans_match_a_full_search(spark):
    pairs = [("e", "p"), ("p", "q"), ("q", "r"), ("r", "q"), ("u", "v"), ("v", "u"), ("v", "w"),
             ("e", "s"), ("s", "q"), ("p", "t"), ("r", "p2"), ("p2", "r")]
    names = sorted({x for p in pairs for x in p})
    n, e = graph(spark, ("r", names, pairs))
    asked = n.select("repo", "id")
    want = set()
    for gone in names:
        left = [p for p in pairs if gone not in p]
        rest = [x for x in names if x != gone]
        seen = {x for x in rest if all(b != x for _, b in left)}
        todo = list(seen)
        while todo:
            at = todo.pop()
            for a, b in left:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(gone, x) for x in rest if x not in seen}
    got = {(r.target, r.id) for r in impact.simulate_removal(n, e, asked).collect()
           if r.kind == "orphaned_file"}
    assert got == want


def test_match_target(spark):
    n = spark.createDataFrame([("r", "src/a/x.py", "src/a/x.py"), ("r", "x.py", "x.py"),
                               ("r", "lib/y.py", "lib/y.py")],
                              "repo STRING, id STRING, file_path STRING")
    ask = spark.createDataFrame([("r", "a/x.py"), ("r", "x.py"), ("r", "/abs/lib/y.py"), ("r", "no")],
                                "repo STRING, argument STRING")
    assert table(impact.match_target(n, ask), "argument", value="id") == {
        ("a/x.py",): "src/a/x.py", ("x.py",): "x.py", ("/abs/lib/y.py",): "lib/y.py"}


def test_closeness_and_betweenness_of_a_large_graph(spark):
    # a line of 2500 nodes: both are whole above any number of nodes
    n = spark.range(2500).selectExpr("'r' AS repo", "id", "'module' AS node_type")
    e = spark.range(2499).where("id % 50 <> 49").selectExpr(
        "'r' AS repo", "id AS source", "id + 1 AS target")
    close = table(centrality.closeness(n, e), "id", value="closeness")
    assert close[0,] == pytest.approx(49 / sum(range(50)) * 49 / 2499)
    between = table(centrality.betweenness(n, e), "id", value="betweenness")
    assert between[2451,] == pytest.approx(1 * 48 / 2499 / 2498)


def test_chains_from_late_entries(spark):
    # only the last of ten entries reaches the target
    pairs = [(f"e{i}", f"x{i}") for i in range(9)] + [("e9", "t")]
    ids = sorted({x for p in pairs for x in p})
    n, e = graph(spark, ("r", ids, pairs))
    want = spark.createDataFrame([("r", "t")], "repo STRING, id STRING")
    got = impact.dependency_chains(n, e, want, k=3).collect()
    assert [(r.rank, r.chain) for r in got] == [(1, ["e9", "t"])]


def test_removal_by_brute_force(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("a", "e"), ("e", "d"), ("f", "b"), ("g", "h"), ("h", "g")]
    ids = list("abcdefgh")
    n, e = graph(spark, ("r", ids, pairs))
    got = {(r.target, r.kind, r.id) for r in impact.simulate_removal(n, e, n.select("repo", "id")).collect()}
    want = set()
    for gone in ids:
        rest = [p for p in pairs if gone not in p]
        left = [i for i in ids if i != gone]
        seen = {i for i in left if i not in {b for _, b in rest}}
        while True:
            more = {b for a, b in rest if a in seen} - seen
            if not more:
                break
            seen |= more
        want |= {(gone, "orphaned_file", i) for i in left if i not in seen}
        want |= {(gone, "broken_import", a) for a, b in pairs if b == gone}
    assert got == want


def test_search_limit_is_per_repo(spark):
    n = spark.createDataFrame([(f"r{i}", f"p{j}", f"p{j}", f"src/p{j}") for i in range(3) for j in range(9)],
                              "repo STRING, id STRING, label STRING, file_path STRING")
    got = explore.node_search(n, "p", limit=4).groupBy("repo").count().collect()
    assert {(r.repo, r["count"]) for r in got} == {("r0", 4), ("r1", 4), ("r2", 4)}
