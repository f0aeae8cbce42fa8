"""The month graphs on odd orders: repeated lines, gaps, several lines of a number."""

import datetime
import itertools

from srcgraph.plans import queries_graph
from srcgraph.plans import views


def test_pairs_of_consecutive_lines(spark, tmp_path):
    day = [datetime.datetime(1992, 1, 5), datetime.datetime(1993, 2, 6)]
    orders = [(o, day[o % 2]) for o in range(6)] + [(3, day[0])]  # an order of two months
    lines = [(o, line, (o * 7 + line * part) % 5) for o in range(7) for line in (1, 2, 4, 5) for part in (1, 2, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    want = set()
    for (o, when), a, b in itertools.product(orders, lines, lines):
        if a[0] == b[0] == o and b[1] == a[1] + 1 and a[2] != b[2]:
            month = (when.year - 1992) * 12 + when.month
            want.add((f"m{month}", month * views.SPAN + a[2], month * views.SPAN + b[2]))
    df = views._month_pairs(spark, str(tmp_path))
    got = [tuple(r) for r in df.select("repo", "source", "target").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # the lines are read and dealt once, and no order table is broadcast by the size of its file
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "Broadcast" not in plan


def test_top_nodes_join_few_rows_to_the_nodes(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(threshold)
    spark.conf.set(threshold, "64k")  # all ranks are more than that
    try:
        plan = queries_graph.top_nodes(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, old)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
