"""Searches take places only for what an origin reaches; answers of tasks meet no table again."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_local import _graph as _random

from srcgraph.operators import build, centrality, cycles, explore, impact, local, spectral


def _star(leaves, out=False):
    """All leaves import the hub 0 (or the hub imports them)."""
    ids = list(range(leaves + 1))
    hub, rest = [0] * leaves, ids[1:]
    return local.Graph([pa.RecordBatch.from_pydict({
        "repo": ["r"] * (2 * leaves + 1), "source": (hub if out else rest) + ids,
        "target": pa.array((rest if out else hub) + [None] * (leaves + 1), pa.int64()),
        "mark": pa.array([0] * leaves + [1] * (leaves + 1), pa.int8())})])


@pytest.mark.parametrize("out", [False, True])
def test_origins_take_places_only_for_what_they_reach(monkeypatch, out):
    monkeypatch.setattr(local, "SLOTS", 1000)
    g = _star(2000, out)
    got = list(local.blocks(g, g.marked(1)))
    assert sum(b.places for b in got) == 4001 and sum(len(b.origins) for b in got) == 2001
    assert len(got) < 50
    # no block of several origins takes more than it may
    assert all(b.places <= 1000 or len(b.origins) == 1 for b in got)


def _graph(spark):
    n = spark.createDataFrame([("r", i, "module" if i % 4 else "external") for i in range(12)],
                              "repo STRING, id LONG, node_type STRING")
    e = spark.createDataFrame([("r", i, (i * 5 + 1) % 12) for i in range(12)] + [("r", 1, 2), ("r", 2, 3), ("r", 3, 3)],
                              "repo STRING, source LONG, target LONG")
    return n, e


def _exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution(
        ).executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("name", ["closeness", "betweenness"])
def test_centralities_come_whole_out_of_the_tasks(spark, name):
    got = getattr(centrality, name)(*_graph(spark))
    assert got.count() == 12 and _exchanges(got) == 1


def _scores(n, e):
    return n.select("repo", "id", (F.ascii(F.substring("id", 3, 1)) / 100.0).alias("pagerank"))


WHOLE = {
    "scores": lambda n, e: impact.impact_scores(n, e, None, _scores(n, e)),
    "scores_of_some": lambda n, e: impact.impact_scores(
        n, e, n.where("id LIKE '%2'").select("repo", "id"), _scores(n, e), 2, True),
    "chains": lambda n, e: impact.dependency_chains(n, e, None, 2),
    "chains_of_some": lambda n, e: impact.dependency_chains(n, e, n.where("id LIKE '%2'").select("repo", "id"), 2, True),
    "roles": explore.standing,
    "texts": lambda n, e: explore.standing(n, e, _scores(n, e)),
}


@pytest.mark.parametrize("name", WHOLE)
def test_one_exchange_in_tasks_and_the_same_rows_by_staged_rounds(spark, monkeypatch, name):
    n, e = _random(spark, 7)
    n = n.withColumn("node_type", F.when(F.col("id").endswith("3"), "external").otherwise("module")).localCheckpoint()
    got = WHOLE[name](n, e)
    inside = _sorted(got)
    assert inside and _exchanges(got) == 1
    monkeypatch.setattr(local, "IN_TASK", 20)  # one repository beyond
    assert inside == _sorted(WHOLE[name](n, e))


def _sorted(df):
    return sorted((tuple(round(v, 10) if isinstance(v, float) else v for v in r)
                   for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_scores_and_cycles_are_those_of_the_lists(spark):
    n, e = _random(spark, 11)
    n = n.withColumn("node_type", F.when(F.col("id").endswith("3"), "external").otherwise("module")).localCheckpoint()
    rank, asked = _scores(n, e), n.select("repo", "id")
    listed = impact.impact_score(n, impact.affected_files(n, e, asked, rank), asked, rank)
    assert _sorted(listed) == _sorted(impact.impact_scores(n, e, None, rank))
    on = cycles.cycle_participation(n, cycles.simple_cycles(n, e)[0]).where("cycle_count > 0").select("repo", "id")
    got = explore.standing(n, e)
    assert _sorted(on) == _sorted(got.where("cycle_count > 0").select("repo", "id")) and on.count()
    deg = got.select("repo", "id", "import_count", "imported_by_count")
    assert _sorted(build.degrees(n, e)) == _sorted(deg)


def test_ranks_found_in_the_pass_are_those_of_pagerank(spark):
    n, e = _random(spark, 7)
    rank = spectral.pagerank(n, e)
    own, given = impact.impact_scores(n, e, None), impact.impact_scores(n, e, None, rank)
    assert _exchanges(own) == 1 and _sorted(own) == _sorted(given)
    assert _sorted(explore.standing(n, e, ranked=True)) == _sorted(explore.standing(n, e, rank))
