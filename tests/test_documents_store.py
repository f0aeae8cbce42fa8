"""Archives, graph documents, snapshot store and report."""

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from srcgraph.functions import paths as P
from srcgraph.functions import urls
from srcgraph.operators import build, compare, explore
from srcgraph.sinks import graph_docs as out
from srcgraph.sinks import report, store
from srcgraph.sources import graph_docs as docs
from srcgraph.sources import store as src
from srcgraph.sources.archive import scan_zip


def small(spark):
    nodes = spark.createDataFrame(
        [("r", "a&b.py", "module", None, "a&b.py"), ("r", "c.py", "module", None, "c.py"),
         ("r", "os", "external", "stdlib", "os")],
        "repo STRING, id STRING, node_type STRING, external_kind STRING, file_path STRING")
    edges = spark.createDataFrame(
        [("r", "a&b.py", "c.py", "from", [1, 2]), ("r", "c.py", "os", "module", [])],
        "repo STRING, source STRING, target STRING, import_type STRING, line_numbers ARRAY<INT>")
    return nodes, edges


def content(nodes, edges):
    return ({(r.id, r.node_type, r.external_kind, r.file_path) for r in nodes.collect()},
            {(r.source, r.target, r.import_type, tuple(r.line_numbers)) for r in edges.collect()})


@pytest.mark.parametrize("limit", [2, 1000])
@pytest.mark.parametrize("lines,read", [
    (out.graphml_lines, docs.read_graphml), (out.gexf_lines, docs.read_gexf),
    (out.json_lines, docs.read_graph_json)])
def test_round_trip(spark, tmp_path, lines, read, limit):
    n, e = small(spark)
    out.write_lines(lines(n, e, limit=limit), str(tmp_path / "doc"))
    assert content(*read(spark, str(tmp_path / "doc"))) == content(n, e)


def test_json_document_is_valid(spark, tmp_path):
    n, e = small(spark)
    meta = spark.createDataFrame([("r", "/p", 2, 2)],
                                 "repo STRING, project_path STRING, total_files INT, total_imports INT")
    rows = out.json_lines(n, e, meta).orderBy("section", "key").collect()
    doc = json.loads("".join(r.value for r in rows))
    assert len(doc["elements"]["nodes"]) == 3 and len(doc["elements"]["edges"]) == 2
    assert doc["metadata"] == {"project_path": "/p", "total_files": 2, "total_imports": 2}
    assert doc["elements"]["edges"][0]["data"]["line_numbers"] == [1, 2]


def test_read_plain_documents(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({
        "nodes": [{"id": "a"}, {"file_path": "b"}, {}],
        "edges": [{"source": "a", "target": "z"}, {"source": "", "target": "a"}], "project_path": "p"}))
    n, e = docs.read_graph_json(spark, str(tmp_path / "flat.json"))
    assert {r.id for r in n.collect()} == {"a", "b", "unknown", "z"}
    assert content(n, e)[1] == {("a", "z", "module", ())}
    assert {r.repo for r in n.collect()} == {"flat"}
    (tmp_path / "u.graphml").write_text(
        '<graphml><graph edgedefault="undirected"><node id="a"/><node id="b"/>'
        '<edge source="a" target="b"/></graph></graphml>')
    n, e = docs.read_graphml(spark, str(tmp_path / "u.graphml"))
    assert {(r.source, r.target) for r in e.collect()} == {("a", "b"), ("b", "a")} and n.count() == 2


def test_zip(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    with zipfile.ZipFile(good / "proj.zip", "w") as z:
        z.writestr("/src/./a.py", "import os\n")
        z.writestr("b/", "")
    got = scan_zip(spark, str(good)).collect()
    assert [(r.repo, r.path, r.ext, r.content) for r in got] == [("proj", "src/a.py", ".py", "import os\n")]
    with pytest.raises(Exception, match="is above"):
        scan_zip(spark, str(good), max_compressed_mb=0).collect()
    with pytest.raises(Exception, match="expands beyond"):
        scan_zip(spark, str(good), max_uncompressed_mb=0).collect()
    for name, make in (("evil", lambda z: z.writestr("../x", "")), ("broken", None)):
        d = tmp_path / name
        d.mkdir()
        if make:
            with zipfile.ZipFile(d / "p.zip", "w") as z:
                make(z)
        else:
            (d / "p.zip").write_bytes(b"nope")
        with pytest.raises(Exception, match="leaves the archive|not a valid ZIP"):
            scan_zip(spark, str(d)).collect()


def test_store(spark, tmp_path):
    n, e = small(spark)
    root = str(tmp_path / "store")
    store.save_analysis(root, "x", {"nodes": n, "edges": e}, "fp1")
    store.save_analysis(root, "y", {"nodes": n, "edges": e.limit(1)}, "fp2")
    store.save_analysis(root, "x", {"nodes": n, "edges": e.limit(1)}, "fp3")
    assert src.load_analysis(spark, root, "x", "edges").count() == 1
    assert src.load_analysis(spark, root, "y").count() == 3
    read = lambda t: src.stored(spark, root, t)
    recent = src.recent_analyses(src.analyses(spark, root), read("nodes"), read("edges"), 5).collect()
    assert {(r.analysis_id, r.nodes, r.edges) for r in recent} == {("x", 3, 1), ("y", 3, 1)}
    assert store.store_stats(spark, root).first().entry_count == 2
    fp = spark.createDataFrame([("r", "fp3"), ("r", "zz")], "repo STRING, fingerprint STRING")
    known = src.analyses(spark, root).withColumn("repo", F.lit("r"))
    assert [r.fingerprint for r in src.unchanged(fp, known).collect()] == ["fp3"]
    with pytest.raises(KeyError):
        store.delete_analysis(spark, root, "nope")
    store.delete_analysis(spark, root, "y")
    assert [r.analysis_id for r in src.analyses(spark, root).collect()] == ["x"]
    old = spark.createDataFrame([("o", store.new_version(), datetime.datetime(2000, 1, 1), "f", False)],
                                src.LOG_SCHEMA)
    store.publish(root, old)
    assert store.expire_analyses(spark, root, 7) == 1
    assert store.expire_analyses(spark, root, 7) == 0
    assert [r.analysis_id for r in src.analyses(spark, root).collect()] == ["x"]


def test_half_saved_snapshot_is_not_seen(spark, tmp_path):
    n, e = small(spark)
    root, name = str(tmp_path / "store"), "own/repo:1"
    store.save_analysis(root, name, {"nodes": n, "edges": e}, "fp1")
    broken = e.withColumn("target", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.save_analysis(root, name, {"nodes": n.limit(1), "edges": broken}, "fp2")
    with pytest.raises(ValueError):
        store.save_analysis(root, name, {"nodes": n.limit(1), "other": e})
    nodes, edges = src.edges_from_analysis(spark, root, name)
    assert (nodes.count(), edges.count()) == (n.count(), e.count())
    assert src.stored(spark, root, "nodes").count() == n.count()
    assert {r.analysis_id for r in src.stored(spark, root, "nodes").collect()} == {name}
    assert [r.fingerprint for r in src.analyses(spark, root).collect()] == ["fp1"]
    # what the failed save left is kept for a day, then cleared; the published version stays
    assert store.vacuum(spark, root) == 0
    assert store.vacuum(spark, root, hours=0) == 1
    assert src.load_analysis(spark, root, name).count() == n.count()
    store.save_analysis(root, name, {"nodes": n.limit(1), "edges": e})
    assert nodes.count() == n.count(), "a reader that began before sees the version it began with"
    assert src.load_analysis(spark, root, name).count() == 1
    assert store.vacuum(spark, root, hours=0) == 2


def test_diff_of_itself_is_empty(spark):
    n, e = small(spark)
    rows = build.degrees(n, e).withColumn("pagerank", F.lit(0.1))
    assert {r.change_type for r in compare.diff_nodes(rows, rows).collect()} == {"unchanged"}
    assert {r.change_type for r in compare.diff_edges(e, e).collect()} == {"unchanged"}


def test_clustering(spark):
    n = spark.createDataFrame([("r", i, "module") for i in range(5)], "repo STRING, id INT, node_type STRING")
    e = spark.createDataFrame([("r", a, b) for a, b in ((0, 1), (1, 2), (2, 0), (2, 3), (3, 2))],
                              "repo STRING, source INT, target INT")
    got = compare.graph_shape(n, e).first()
    assert (got.total_nodes, got.total_edges, got.num_components, got.is_connected) == (5, 5, 2, False)
    assert got.avg_clustering == pytest.approx((1 + 1 + 1 / 3) / 5, abs=1e-6)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v STRING").select(column(F.col("v")).alias("o")).first().o


def test_urls(spark):
    assert one(spark, urls.normalize_repo_url, " https://GitHub.com/User/Repo.git ") == "https://github.com/User/Repo"
    assert one(spark, urls.normalize_repo_url, "https://x.io/a/b/?q=1#f") == "https://x.io/a/b"
    for bad in ("http://github.com/a/b", "git@github.com:a/b", "https://github.com", "https://github.com/", ""):
        assert one(spark, urls.valid_repo_url, bad) is False
    ok = lambda c: urls.valid_repo_url(c, ["github.com"])
    assert one(spark, ok, "https://GitHub.com:443/a/b") is True
    assert one(spark, ok, "https://evil.com/a/b") is False
    plain = one(spark, urls.repo_cache_id, "https://github.com/a/b.git")
    assert plain == one(spark, urls.repo_cache_id, "https://GITHUB.com/a/b/") and len(plain) == 29
    assert plain != one(spark, lambda c: urls.repo_cache_id(c, F.lit("main")), "https://github.com/a/b")


def test_paths(spark):
    cases = [
        (P.resolve_dots, "a/b/../c/./d", "a/c/d"), (P.resolve_dots, "../x", None),
        (P.resolve_dots, "a/../../x", None), (P.resolve_dots, "/a//b/", "a/b"), (P.resolve_dots, "a/..", ""),
        (P.normalize_path, "a\\\\b//c", "a/b/c"), (P.folder_path, "a/b/c.py", "a/b"), (P.folder_path, "c.py", ""),
        (P.extension, "a.d/b", ""), (P.extension, "a/b.tar.gz", ".gz"), (P.extension, ".env", ""),
        (P.drop_extension, "a/foo.service", "a/foo"), (P.normalize_file_key, "\\a\\b.py", "a/b.py")]
    for fn, given, want in cases:
        assert one(spark, fn, given) == want, (fn.__name__, given)
    rel = lambda base: (lambda c: P.relative_path(c, F.lit(base)))
    assert one(spark, rel("/Root/P/"), "/root/p/src/a.py") == "src/a.py"
    assert one(spark, rel("/root/p"), "/root/project/a.py") == "root/project/a.py"
    assert one(spark, rel(""), "/x/y") == "x/y"
    under = lambda c: P.is_under_folder(c, F.lit("src/a"))
    assert [one(spark, under, p) for p in ("src/a", "/src/a/b.py", "src/ab.py")] == [True, True, False]


def test_line_window(spark):
    f = spark.createDataFrame([("r", "x/a.py", "l1\nl2\nl3\nl4\n")], "repo STRING, path STRING, content STRING")
    rows = explore.line_window(f, 1, 2, 1).collect()
    assert [(r.line_number, r.text, r.total_lines, r.language) for r in rows] == [
        (1, "l1", 4, "py"), (2, "l2", 4, "py"), (3, "l3", 4, "py")]


def test_report(spark):
    m = spark.createDataFrame([("r", 2, 3, 1, 4, 0, 1.5, 2, "a", "b", 1)], """repo STRING, total_files INT,
        total_imports INT, total_cycles INT, max_import_depth INT, isolated_count INT, avg_imports_per_file DOUBLE,
        max_imports_in_file INT, max_imports_file STRING, most_imported_module STRING, most_imported_count INT""")
    c = spark.createDataFrame([("r", ["a", "b"], 2)], "repo STRING, cycle ARRAY<STRING>, length INT")
    i = spark.createDataFrame([], "repo STRING, id STRING")
    doc = json.loads(report.report(report.report_rows(m, c, i)).first().report)
    assert doc["circular_dependencies"] == [["a", "b"]] and doc["statistics"]["avg_imports_per_file"] == 1.5
