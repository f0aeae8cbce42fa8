"""match_target against brute force, and without a row for every ending of a path."""

import itertools
import random

from srcgraph.operators import impact


def test_match_target_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab/ä") for _ in range(rng.randint(0, 6)))
    nodes = [(rng.choice(["r", "s", None]), word(), rng.choice([None, word()])) for _ in range(60)]
    nodes += [("r", "bab", "bab"), ("r", "bab", None), ("r", None, "a/b"), ("r", "ab", "long/er")]
    asked = {(r, word()) for r in ("r", "s", "none") for _ in range(80)} | {("r", ""), ("r", "a/b"), ("s", ""), ("r", "long/er")}
    want = {}
    for repo, arg in asked:
        found = []
        for r, i, path in nodes:
            if r != repo:
                continue
            if i is None:
                found += [((-99, 0, ""), None)] if path == arg else []
            elif arg == (i if path is None else path) or i.endswith(arg) or (i and arg.endswith(i)):
                found.append(((-min(len(i), len(arg)), abs(len(i) - len(arg)), i), i))
        if found:
            want[repo, arg] = min(found, key=lambda x: x[0])[1]
    n = spark.createDataFrame(nodes, "repo STRING, id STRING, file_path STRING")
    ask = spark.createDataFrame([*asked, ("r", None), (None, "a")], "repo STRING, argument STRING")
    got = impact.match_target(n, ask.union(ask)).collect()
    assert len(got) == len(want) and {(r.repo, r.argument): r.id for r in got} == want


def test_match_target_writes_no_ending(spark):
    paths = ["/".join(p) for p in itertools.product("abcd", repeat=4)]
    n = spark.createDataFrame([("r", p, p) for p in paths], "repo STRING, id STRING, file_path STRING")
    got = impact.match_target(n, n.select("repo", n.id.alias("argument")))
    assert got.where("id = argument").count() == len(paths)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
