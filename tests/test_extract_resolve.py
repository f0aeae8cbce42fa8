"""Extraction, resolution and graph build on literal sources."""

import textwrap

import pytest
from pyspark.sql import functions as F

from srcgraph.operators import build, extract, resolve
from srcgraph.plans.analyze import analyze, graph_of
from srcgraph.sources import configs
from srcgraph.sources.files import DEFAULT_IGNORE, filter_ignored, is_ignored, scan_files, validate_globs


def files(spark, tree, repo="r"):
    rows = [(repo, p, "." + p.rsplit(".", 1)[1] if "." in p.rsplit("/", 1)[-1] else "",
             len(c), None, textwrap.dedent(c).lstrip("\n")) for p, c in tree.items()]
    return spark.createDataFrame(
        rows, "repo STRING, path STRING, ext STRING, size_bytes BIGINT, mtime TIMESTAMP, content STRING")


def imports(spark, name, text, mode="exact"):
    got = extract.extract_imports(files(spark, {name: text}), mode).orderBy("line_number", "pos").collect()
    return [(r.imported_module, r.import_type, r.line_number) for r in got]


def test_python(spark):
    assert imports(spark, "t.py", "from . import module\nfrom ..parent import something\n") == [
        (".", "from", 1), ("..parent", "from", 2)]
    assert imports(spark, "t.py", "from typing import (\n  A,\n  B,\n  C,\n)\n") == [("typing", "from", 1)]
    bad = "import os\nthis is invalid syntax\n"
    assert imports(spark, "t.py", bad) == []
    assert imports(spark, "t.py", bad, "line") == [("os", "module", 1)]
    lines = "# comment\nimport os\n\nimport sys\n"
    for mode in ("exact", "line"):
        assert imports(spark, "t.py", lines, mode) == [("os", "module", 2), ("sys", "module", 4)]
    assert imports(spark, "t.py", "import a, b as c, d.e\nimport x \\\n", "line") == [
        ("a", "module", 1), ("b", "module", 1), ("d.e", "module", 1)]


JS = """import React from 'react';
import { useState } from 'react';
import * as utils from './utils';
import Default, { named } from './module';
import './styles.css';
const lodash = require('lodash');
const fs = require("fs");
const m = import('./dynamic-module');
export { foo } from './foo';
export * from './barrel';
"""


def test_javascript(spark):
    exact = imports(spark, "a.js", JS)
    assert exact == [
        ("react", "module", 1), ("react", "module", 2), ("./utils", "module", 3), ("./module", "module", 4),
        ("./styles.css", "module", 5), ("lodash", "require", 6), ("fs", "require", 7),
        ("./dynamic-module", "dynamic", 8), ("./foo", "export-from", 9), ("./barrel", "export-all", 10)]
    line = imports(spark, "a.js", JS, "line")
    assert line == [
        ("react", "module", 1), ("react", "module", 2), ("./utils", "module", 3), ("./module", "module", 4),
        ("./styles.css", "module", 5), ("lodash", "from", 6), ("fs", "from", 7),
        ("./dynamic-module", "module", 8)]
    multi = "import {\n  a,\n  b,\n  c\n} from './multiline-module';\n\nimport X\n  from\n  './another-module';\n"
    assert imports(spark, "a.js", multi) == [
        ("./multiline-module", "module", 1), ("./another-module", "module", 7)]
    # an alias matches two of the line patterns
    assert imports(spark, "a.js", "import { a as b } from 'm'\n", "line") == [
        ("m", "module", 1), ("m", "module", 1)]
    hidden = """// import a from 'x'
/* import b from 'y'
import c from 'z' */
const s = "import d from 'w'";
const t = `
import e from 'v'
`;
import f from 'real';
"""
    assert imports(spark, "a.js", hidden) == [("real", "module", 8)]
    assert imports(spark, "a.js", "// import x from './no'\nimport a from './foo'\nimport b from './bar'\n") == [
        ("./foo", "module", 2), ("./bar", "module", 3)]


def test_typescript(spark):
    text = """import type { User } from './types';
import { Component } from '@angular/core';
import { Observable } from 'rxjs';
import path = require('path');
export * from './config';
"""
    got = imports(spark, "a.ts", text)
    assert {m for m, _, _ in got} == {"./types", "@angular/core", "rxjs", "path", "./config"}
    assert ("./types", "from", 1) in got


def test_go(spark):
    text = 'package main\n\nimport (\n\t"fmt"\n\th "net/http"\n\t_ "github.com/lib/pq"\n\t// "no"\n\t. "encoding/json"\n)\n'
    assert imports(spark, "a.go", text) == [
        ("fmt", "module", 4), ("net/http", "module", 5), ("github.com/lib/pq", "module", 6),
        ("encoding/json", "module", 8)]
    assert imports(spark, "a.go", '// import "fmt"\nimport "os"\n/* import "net/http" */\n') == [
        ("os", "module", 2)]
    assert imports(spark, "a.go", 'import ("a/b"; "c")\nimport x "d.e/f"\n')[-1] == ("d.e/f", "module", 2)


def test_java(spark):
    text = """package a;
/* import java.util.List;
import java.io.File; */
import java.util.ArrayList;
import static java.lang.Math.PI;
import java.util.*; // all
class A { String s = "import no.such.Thing; // x"; }
"""
    assert imports(spark, "A.java", text) == [
        ("java.util.ArrayList", "module", 4), ("java.lang.Math.PI", "from", 5), ("java.util.*", "module", 6)]


def test_comment_stripping_of_long_tokens(spark):
    text = '"' + "x" * 400_000 + '" /* ' + "y\n" * 100_000 + "*/\nimport a.B;\n"
    assert imports(spark, "A.java", text) == [("a.B", "module", 100_002)]


def test_ruby_cpp_rust(spark):
    assert imports(spark, "a.rb", "require 'json'\nrequire_relative('x/y')\n# require 'no'\nload \"z.rb\"\n") == [
        ("json", "require", 1), ("x/y", "require_relative", 2), ("z.rb", "load", 4)]
    assert imports(spark, "a.cpp", '#include "x.h"\n# include <vector>\n// #include "no.h"\n') == [
        ("x.h", "local", 1), ("vector", "system", 2)]
    # unanchored patterns are kept as they are
    assert imports(spark, "a.rs", "mod util;\nuse crate::a::b;\nextern crate serde;\nlet x = because y;\n") == [
        ("util", "mod", 1), ("crate::a::b", "use", 2), ("serde", "extern_crate", 3), ("y", "use", 4)]


def test_locations(spark):
    f = files(spark, {"a.py": "import os, sys as s  # c\nfrom m import (a, b)\n",
                      "b.ts": "import { x, y as z } from 'm'\nimport D from 'd'\nimport * as n from 'n'\n"
                              "const q = require('q')\nfoo(import('r'))\n"})
    got = {(r.path, r.line_number): (r.import_type, r.imported_names)
           for r in extract.import_locations(f).collect()}
    assert got == {
        ("a.py", 1): ("import", ["os", "sys"]), ("a.py", 2): ("from_import", ["(a", "b)"]),
        ("b.ts", 1): ("import", ["x", "y"]), ("b.ts", 2): ("import", ["D"]), ("b.ts", 3): ("import", []),
        ("b.ts", 4): ("require", []), ("b.ts", 5): ("dynamic", [])}


def resolved(spark, tree, asks):
    f = files(spark, tree)
    rows = spark.createDataFrame(
        [("r", s, m, "module", i, i) for i, (s, m) in enumerate(asks)],
        "repo STRING, source_file STRING, imported_module STRING, import_type STRING, line_number INT, pos INT")
    got = resolve.resolve_imports(rows, f, configs.project_configs(f)).collect()
    return {(r.source_file, r.imported_module): (r.target, r.external_kind) for r in got}


def check(spark, tree, cases):
    got = resolved(spark, tree, list(cases))
    for ask, want in cases.items():
        target, kind = got[ask]
        assert (target if kind is None else kind) == want, ask


def test_resolve_javascript(spark):
    tree = {
        "src/components/Button.tsx": "", "src/components/index.ts": "", "src/utils/helper.js": "",
        "src/utils/helper.ts": "", "src/utils/index.js": "", "src/main.ts": "", "lib/config.js": "",
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "~/lib/*": ["lib/*"]}}}'}
    m = "src/main.ts"
    check(spark, tree, {
        (m, "./components/Button"): "src/components/Button.tsx", (m, "./utils/helper.js"): "src/utils/helper.js",
        (m, "./utils/helper"): "src/utils/helper.js", (m, "./components"): "src/components/index.ts",
        ("src/components/Button.tsx", "../utils"): "src/utils/index.js",
        (m, "@/utils/helper"): "src/utils/helper.js", (m, "~/lib/config"): "lib/config.js",
        (m, "lib/config"): "lib/config.js", (m, "/lib/config"): "lib/config.js", (m, "react"): "package",
        (m, "fs"): "stdlib", (m, "node:path"): "stdlib", (m, "fs/promises"): "stdlib",
        (m, "./missing"): "package", (m, "../../outside"): "package", (m, "@/none"): "package"})


def test_resolve_go(spark):
    tree = {"go.mod": "module github.com/user/myproject\n\ngo 1.21\n", "main.go": "",
            "internal/api/handler.go": "", "pkg/utils/helper.go": "", "docs/x.md": ""}
    p = "github.com/user/myproject"
    check(spark, tree, {
        ("main.go", "fmt"): "stdlib", ("main.go", "net/http/httputil"): "stdlib",
        ("main.go", "github.com/lib/pq"): "package", ("main.go", p + "/internal/api"): "internal/api",
        ("pkg/utils/helper.go", "../../internal/api"): "internal/api", ("main.go", p + "/docs"): "package",
        ("main.go", p + "/none"): "package", ("main.go", p): "."})


def test_resolve_java(spark):
    base = "src/main/java/com/example/"
    tree = {"pom.xml": "<project/>", base + "Main.java": "", base + "utils/Helper.java": ""}
    s = base + "Main.java"
    check(spark, tree, {
        (s, "com.example.utils.Helper"): base + "utils/Helper.java", (s, "com.example.utils.*"): "package",
        (s, "java.util.List"): "stdlib", (s, "java.util.*"): "stdlib", (s, "javax.swing.text.html.X"): "stdlib",
        (s, "javax.inject.Inject"): "package", (s, "org.x.Y"): "package"})
    check(spark, {"pom.xml": "<sourceDirectory> app/java </sourceDirectory>", "app/java/a/B.java": "",
                  "src/main/java/a/C.java": ""},
          {("app/java/a/B.java", "a.B"): "app/java/a/B.java", ("app/java/a/B.java", "a.C"): "package"})
    check(spark, {"build.gradle": "java { srcDirs = ['one', \"two\"] }", "two/a/B.java": "", "one/a/B.java": ""},
          {("two/a/B.java", "a.B"): "one/a/B.java"})
    check(spark, {"src/a/B.java": "", "a/C.java": ""},
          {("src/a/B.java", "a.B"): "src/a/B.java", ("src/a/B.java", "a.C"): "a/C.java"})


def test_resolve_others(spark):
    check(spark, {"a/b.rb": "", "lib/c.rb": "", "d.rb": "", "a/x.json": ""}, {
        ("a/b.rb", "./b"): "a/b.rb", ("a/b.rb", "b"): "a/b.rb", ("a/b.rb", "c"): "lib/c.rb",
        ("a/b.rb", "d"): "d.rb", ("a/b.rb", "../d"): "d.rb", ("a/b.rb", "./d"): "package",
        ("a/b.rb", "x.json"): "a/x.json"})
    check(spark, {"a/b.cpp": "", "a/b.h": "", "include/c.h": "", "src/d.h": "", "a/c.h": ""}, {
        ("a/b.cpp", "b.h"): "a/b.h", ("a/b.cpp", "c.h"): "a/c.h", ("src/d.h", "c.h"): "include/c.h",
        ("a/b.cpp", "d.h"): "src/d.h", ("a/b.cpp", "vector"): "package"})
    check(spark, {"src/main.rs": "", "src/util.rs": "", "src/net/mod.rs": "", "src/net/tcp.rs": ""}, {
        ("src/main.rs", "util"): "src/util.rs", ("src/main.rs", "net"): "src/net/mod.rs",
        ("src/main.rs", "crate::net::tcp"): "src/net/tcp.rs", ("src/main.rs", "crate::net"): "src/net/mod.rs",
        ("src/main.rs", "std::io"): "package", ("src/main.rs", "serde"): "package"})
    check(spark, {"pkg/__init__.py": "", "pkg/a.py": "", "pkg/sub/b.py": "", "c.py": "", "d/__init__.py": "", "d.py": ""}, {
        ("pkg/a.py", "."): "pkg/__init__.py", ("pkg/sub/b.py", "..a"): "pkg/a.py", ("pkg/a.py", "..c"): "c.py",
        ("pkg/a.py", "c"): "c.py", ("pkg/a.py", "d"): "d/__init__.py", ("pkg/a.py", "pkg.sub.b"): "pkg/sub/b.py",
        ("pkg/a.py", "...c"): "package", ("pkg/a.py", "os.path"): "stdlib", ("pkg/a.py", "numpy"): "package"})


def test_spellings_collapse(spark):
    tree = {"mymod.py": "", "caller.py": "import mymod\nfrom mymod import x\n",
            "pkg/__init__.py": "", "pkg/caller.py": "import mymod\nfrom ..mymod import y\nimport os\nfrom os import path\n"}
    nodes, edges, _ = graph_of(files(spark, tree))
    got = {(r.source, r.target): r.line_numbers for r in edges.collect()}
    assert got == {("caller.py", "mymod.py"): [1, 2], ("pkg/caller.py", "mymod.py"): [1, 2],
                   ("pkg/caller.py", "os"): [3, 4]}
    kinds = {r.id: (r.node_type, r.external_kind) for r in nodes.collect()}
    assert kinds["os"] == ("external", "stdlib") and len(kinds) == 4
    every, _, _ = graph_of(files(spark, tree), include_all_files=True)
    assert every.count() == 5


def test_analyze_portfolio(spark):
    one = files(spark, {"main.py": "import utils\n", "utils.py": "import os\nimport sys\n"}, "one")
    two = files(spark, {"a.py": "import b\n", "b.py": "import a\nimport numpy\n",
                        "node_modules/x.js": "import './y'\n"}, "two")
    got = analyze(one.unionByName(two), max_rounds=5)
    m = {r.repo: r for r in got["metrics"].collect()}
    assert (m["one"].total_files, m["one"].external_node_count, m["one"].total_imports) == (2, 2, 3)
    assert (m["one"].max_import_depth, m["one"].total_cycles, m["one"].largest_scc_size) == (2, 0, 1)
    assert (m["two"].total_cycles, m["two"].max_cycle_length, m["two"].largest_scc_size) == (1, 2, 2)
    nodes = {(r.repo, r.id): r for r in got["nodes"].collect()}
    assert len(nodes) == 7
    assert nodes["two", "a.py"].cycle_count == 1 and nodes["one", "utils.py"].depth == 1
    assert nodes["one", "utils.py"].external_ratio == 1.0 and nodes["one", "os"].label == "os"
    assert sum(r.pagerank for k, r in nodes.items() if k[0] == "one") == pytest.approx(1)
    assert nodes["one", "main.py"].line_count == 1
    light = analyze(one, level="light")["metrics"].first()
    assert (light.total_files, light.total_cycles) == (2, 0)


def test_go_packages_as_nodes(spark):
    tree = {"go.mod": "module m.io/x\n", "a/a.go": 'import "m.io/x/b"\n', "b/b.go": 'import "m.io/x/a"\n'}
    _, edges, _ = graph_of(files(spark, tree), go_package_nodes=True)
    assert {(r.source, r.target) for r in edges.collect()} == {("a", "b"), ("b", "a")}


def test_globs():
    assert validate_globs([" a ", "", "*.x"]) == ["a", "*.x"]
    for bad in (["a" * 201], ["****"], ["(a)*"], ["(a)+"], ["(a){2}"], [".*.*"], ["x"] * 101, [3], "x"):
        with pytest.raises(ValueError):
            validate_globs(bad)
    assert len(DEFAULT_IGNORE) == 32


def test_ignore(spark):
    paths = ["src/a.py", "node_modules/x/a.js", "x.egg-info/b.py", "builds/a.py", "a/build/c.py", "m.pyc", "a+b/c.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    assert {r.path for r in filter_ignored(df).collect()} == {"src/a.py", "builds/a.py", "a+b/c.py"}
    assert df.where(is_ignored("path", ["a+b", "[sm]rc"])).count() == 6


def test_scan_files(spark, tmp_path):
    for p in ("one/a.py", "one/sub/b.js", "two/go.mod", "two/x.go", "two/vendor/y.go", "two/readme.md"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("import os\n")
    got = scan_files(spark, str(tmp_path))
    assert {(r.repo, r.path, r.ext) for r in got.collect()} == {
        ("one", "a.py", ".py"), ("one", "sub/b.js", ".js"), ("two", "go.mod", ".mod"), ("two", "x.go", ".go")}
    assert scan_files(spark, str(tmp_path / "one"), "r").count() == 2


def test_match_lines_by_plain_search(spark):
    import random
    import re

    from srcgraph.operators.extract import match_lines
    pattern = r"im(\s+\w)*\s*;"
    rng = random.Random(3)
    texts = ["".join(rng.choice(["im", " ", "\n", "a", ";", "im a;", "im\na;", "\x01", "im;im;"])
                     for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["im a\n;" * 20000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = dict(df.select("i", match_lines(F.col("t"), pattern).alias("m")).collect())
    for i, t in enumerate(texts):
        assert [(m.m, m.line) for m in got[i]] == [
            (x.group(), t.count("\n", 0, x.start()) + 1) for x in re.finditer(pattern, t)]
