"""Documents of one repository declare the same attributes; each value is joined with one declaration."""

import pytest
from pyspark.sql import functions as F

from srcgraph.sinks import graph_docs as out_docs
from srcgraph.sources import graph_docs as in_docs
from srcgraph.stage import Stage


@pytest.mark.parametrize("kind", ["graphml", "gexf"])
def test_declarations_of_many_documents_count_once(spark, monkeypatch, kind):
    n = spark.range(40).select(
        F.lit("r").alias("repo"), F.col("id").cast("string").alias("id"), F.lit("module").alias("node_type"),
        F.lit("package").alias("external_kind"), F.col("id").cast("string").alias("file_path"))
    e = n.select("repo", F.col("id").alias("source"), F.lit("0").alias("target"),
                 F.lit("from").alias("import_type"), F.array(F.lit(1)).alias("line_numbers"))
    path = Stage(spark, "document").root
    out_docs.write_lines(getattr(out_docs, f"{kind}_lines")(n, e, 10), path)
    sizes, wide = [], in_docs._wide
    monkeypatch.setattr(in_docs, "_wide", lambda rows, *rest: (sizes.append(rows.count()), wide(rows, *rest))[1])
    nodes, edges = getattr(in_docs, f"read_{kind}")(spark, path)
    assert nodes.where("file_path = id AND external_kind = 'package'").count() == 40
    assert edges.where("import_type = 'from' AND line_numbers[0] = 1").count() == 40
    assert sizes == ([120, 80])


@pytest.mark.parametrize("kind", ["graph_json", "graphml", "gexf"])
def test_documents_as_rows_read_as_files_do(spark, kind):
    n = spark.range(12).select(
        F.lit("r").alias("repo"), F.concat(F.col("id").cast("string"), F.lit("<&\">")).alias("id"),
        F.lit("module").alias("node_type"), F.when(F.col("id") % 2 == 0, "package").alias("external_kind"),
        F.lit("a b.py").alias("file_path"))
    e = n.select("repo", F.col("id").alias("source"), F.lit("x").alias("target"),
                 F.lit("from").alias("import_type"), F.array(F.lit(1), F.lit(2)).alias("line_numbers"))
    write = {"graph_json": lambda: out_docs.json_lines(n, e, None, 5),
             "graphml": lambda: out_docs.graphml_lines(n, e, 5), "gexf": lambda: out_docs.gexf_lines(n, e, 5)}[kind]
    docs = out_docs.documents(write())
    assert docs.count() == 5
    path = Stage(spark, "document").root
    out_docs.write_lines(write(), path)
    read = getattr(in_docs, f"read_{kind}")
    for a, b in zip(read(spark, docs), read(spark, path)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() >= 12
