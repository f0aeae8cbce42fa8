"""Folder metrics find directories and edges inside folders once."""

from srcgraph.operators import folders


def test_edges_inside_folders_are_found_once(spark, monkeypatch):
    paths = ["a/x.py", "a/b/y.py", "a/b/z.py", "w.py", None]
    nodes = spark.createDataFrame(
        [("r", i, "external" if p is None else "module", None, p, i * 10, None) for i, p in enumerate(paths)],
        "repo string, id long, node_type string, external_kind string, file_path string, size_bytes long, line_count long")
    edges = spark.createDataFrame([("r", 0, 1), ("r", 1, 2), ("r", 2, 1), ("r", 2, 4), ("r", 3, 0)],
                                  "repo string, source long, target long")
    calls, real = [], folders.folder_edges
    monkeypatch.setattr(folders, "folder_edges", lambda *a: calls.append(1) or real(*a))
    got = {r["folder"]: r for r in folders.folder_metrics(nodes, edges).collect()}
    assert len(calls) == 1
    assert set(got) == {"a", "a/b"}
    a, b = got["a"], got["a/b"]
    assert (a["total_files"], a["total_imports"], a["max_import_depth"], a["total_cycles"]) == (3, 3, 2, 1)
    assert (b["total_files"], b["total_imports"], b["max_import_depth"], b["largest_scc_size"]) == (2, 2, 0, 2)
    assert (a["external_node_count"], a["external_edges"]) == (2, 2)
    assert (a["largest_file_path"], a["max_imports_file"], a["most_imported_module"]) == ("a/b/z.py", "a/x.py", "y.py")
