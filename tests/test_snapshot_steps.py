"""The snapshot summary counts the degrees of each snapshot once."""

from srcgraph.operators import build, compare
from srcgraph.plans import queries_explore


def test_degrees_of_a_snapshot_are_counted_once(spark, monkeypatch):
    calls, real = [], build.degrees
    counted = lambda *a: calls.append(1) or real(*a)
    monkeypatch.setattr(build, "degrees", counted)
    monkeypatch.setattr(compare, "degrees", counted)
    assert queries_explore.diff_summary(spark, "/root/testdata/sf0.001").columns
    assert len(calls) == 2
