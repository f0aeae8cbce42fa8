"""Cycles that only one of two snapshots has."""

import random

from pyspark.sql import functions as F

from srcgraph.operators import compare
from srcgraph.operators.cycles import simple_cycles


def graph(spark, rows):
    edges = spark.createDataFrame(rows, "repo STRING, source LONG, target LONG")
    nodes = edges.select("repo", F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes, edges


def cycles_of(spark, rows):
    return {(r.repo, tuple(r.cycle)) for r in simple_cycles(*graph(spark, rows))[0].collect()}


def test_changed_cycles_are_the_difference_of_all_cycles(spark):
    rng = random.Random(21)
    before = [(repo, a, b) for repo in "rs" for a in range(7) for b in range(7) if rng.random() < 0.25]
    after = [e for e in before if e != ("r", 1, 2)] + [("r", 1, 1), ("s", 9, 0), ("s", 0, 9), ("r", 5, 2)]
    one, two = cycles_of(spark, before), cycles_of(spark, after)
    got = {(r.repo, tuple(r.cycle), r.change_type) for r in compare.changed_cycles(
        *graph(spark, before), *graph(spark, after)).collect()}
    assert got == {(*c, "removed") for c in one - two} | {(*c, "added") for c in two - one}
    assert one - two and two - one


def test_quick_compare_counts_cycles(spark):
    before = [("r", 1, 2), ("r", 2, 1), ("r", 2, 3), ("r", 3, 1), ("s", 1, 2)]
    after = [("r", 1, 2), ("r", 2, 1), ("r", 2, 3), ("s", 1, 2), ("s", 2, 1)]
    report = spark.createDataFrame(
        [("r", 3, 4, 2, 1), ("s", 2, 1, None, 1)],
        "repo STRING, total_files LONG, total_imports LONG, circular_dependencies LONG, max_import_depth LONG")
    got = {r.repo: r for r in compare.quick_compare(
        *graph(spark, before), *graph(spark, after), report, report).collect()}
    assert (got["r"].circular_dependencies_change, got["r"].circular_dependencies_after, got["r"].improvement) == (-1, 1, True)
    assert (got["s"].circular_dependencies_change, got["s"].circular_dependencies_after, got["s"].improvement) == (1, None, False)
    same = compare.changed_cycles(*graph(spark, before), *graph(spark, before))
    assert same.count() == 0
