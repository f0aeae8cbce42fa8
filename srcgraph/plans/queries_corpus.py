"""Queries on the source corpus: scan, extraction, resolution, graph build."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcgraph.functions import languages, urls
from srcgraph.functions.paths import folder_path
from srcgraph.operators import build, extract, resolve
from srcgraph.plans.registry import query
from srcgraph.plans.views import _EXT, _HEAD, _TAIL, CORPUS, _sql_list, corpus, table
from srcgraph.sources import configs
from srcgraph.sources import files as file_source
from srcgraph.stage import Stage, staged_once

COLS = "repo, source_file, imported_module, import_type, line_number"


def _imports(spark, sf, mode="exact", exts=None):
    return extract.extract_imports(corpus(spark, sf), mode, exts).drop("pos")


def _resolved(spark, sf):
    def build_it():
        files = corpus(spark, sf)
        return resolve.resolve_imports(
            extract.extract_imports(files), files, configs.project_configs(files))
    return staged_once(spark, "corpus_resolved", sf, build_it)


def corpus_graph(spark, sf):
    got = _resolved(spark, sf)
    nodes = staged_once(spark, "corpus_nodes", sf, lambda: build.build_nodes(got))
    edges = staged_once(spark, "corpus_edges", sf, lambda: build.build_edges(got))
    return nodes, edges


# --- scan -----------------------------------------------------------------------------------

# the corpus with a folder that the ignore globs drop in front of every 10th file
MIXED = CORPUS + """, mixed AS (
  SELECT repo, CASE k % 20 WHEN 0 THEN 'node_modules/' WHEN 10 THEN 'lib.egg-info/' ELSE '' END || path
         AS path, ext, k FROM f)"""


def _mixed(spark, sf):
    # the mtime of a corpus file carries its key
    key = F.unix_seconds("mtime") - 1700000000
    front = F.when(key % 20 == 0, "node_modules/").when(key % 20 == 10, "lib.egg-info/").otherwise("")
    return corpus(spark, sf).where(F.col("ext").isin(_EXT)).select(
        "repo", F.concat(front, "path").alias("path"), "ext")


@query("scan_files", """SELECT 'lang=' || lang AS repo, sum(strlen(text) + 1)::BIGINT AS bytes,
  sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY 1""")
def scan_files(spark, sf):
    # the texts as files in one folder per language
    root = Stage(spark, "scan").root
    table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").text(root)
    return file_source.scan_files(spark, root, all_files=True).groupBy("repo").agg(
        F.sum("size_bytes").alias("bytes"), F.sum(F.length("content")).alias("chars"))


@query("filter_ignored", MIXED + """
SELECT repo, path FROM mixed WHERE k % 10 <> 0""")
def filter_ignored(spark, sf):
    return file_source.filter_ignored(_mixed(spark, sf)).select("repo", "path")


@query("validate_globs", MIXED + """
SELECT repo, count(*) AS files FROM mixed WHERE k % 10 <> 0 AND NOT contains(path, '/e3/')
GROUP BY 1""")
def validate_globs(spark, sf):
    return file_source.filter_ignored(_mixed(spark, sf), [" e3 ", ""]).groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"))


@query("scan_lines", """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents),
c AS (SELECT doc_id, lines, len(lines) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END
      AS total_lines FROM t)
SELECT CAST(doc_id AS VARCHAR) AS path, total_lines, i AS line_number, lines[i] AS text
FROM c, LATERAL (SELECT unnest(range(1, 7)) AS i) WHERE i <= total_lines""")
def scan_lines(spark, sf):
    from srcgraph.operators.explore import line_window
    docs = table(spark, sf, "documents").select(
        F.lit("docs").alias("repo"), F.col("doc_id").cast("string").alias("path"),
        F.col("text").alias("content"))
    return line_window(docs, 3, 4, 2).select("path", "total_lines", "line_number", "text")


# --- extraction -----------------------------------------------------------------------------

def _lang(lang: int) -> str:
    return CORPUS + f"SELECT {COLS} FROM imp WHERE lang = {lang}"


@query("extract_python", _lang(0))
def extract_python(spark, sf):
    return _imports(spark, sf, "exact", [".py"])


@query("extract_python_lines", _lang(0))
def extract_python_lines(spark, sf):
    return _imports(spark, sf, "line", [".py"])


@query("extract_js", CORPUS + """SELECT repo, source_file, imported_module,
  CASE import_type WHEN 'require' THEN 'from' ELSE import_type END AS import_type, line_number
FROM imp WHERE lang = 1""")
def extract_js(spark, sf):
    return _imports(spark, sf, "line", [".js"])


@query("extract_ts_types", CORPUS + f"""SELECT {COLS} FROM imp
WHERE lang = 7 AND import_type = 'from'""")
def extract_ts_types(spark, sf):
    return _imports(spark, sf, "line", [".ts"]).where("import_type = 'from'")


@query("extract_ts_lines", CORPUS + f"""SELECT {COLS} FROM imp WHERE lang = 7
AND import_type <> 'export-all' AND NOT (line_number = 3 AND import_type = 'module')""")
def extract_ts_lines(spark, sf):
    return _imports(spark, sf, "line", [".ts"])


@query("extract_js_ast", CORPUS + f"SELECT {COLS} FROM imp WHERE lang IN (1, 7)")
def extract_js_ast(spark, sf):
    return _imports(spark, sf, "exact", [".js", ".ts"])


@query("extract_go", _lang(2))
def extract_go(spark, sf):
    return _imports(spark, sf, "exact", [".go"])


@query("extract_java", _lang(3))
def extract_java(spark, sf):
    return _imports(spark, sf, "exact", [".java"])


@query("extract_ruby", _lang(4))
def extract_ruby(spark, sf):
    return _imports(spark, sf, "exact", [".rb"])


@query("extract_cpp", _lang(5))
def extract_cpp(spark, sf):
    return _imports(spark, sf, "exact", [".h"])


@query("extract_rust", _lang(6))
def extract_rust(spark, sf):
    return _imports(spark, sf, "exact", [".rs"])


@query("import_locations", CORPUS + """
SELECT repo, path, 2 AS line_number, CASE lang WHEN 0 THEN 'import os.path' WHEN 1 THEN 'import fs from ''fs'''
  ELSE 'import path from ''node:path''' END AS line_content, 'import' AS import_type,
  CASE lang WHEN 0 THEN 'os.path' WHEN 1 THEN 'fs' ELSE 'path' END AS names FROM f WHERE lang IN (0, 1, 7)
UNION ALL
SELECT repo, path, 3, CASE lang WHEN 0 THEN 'import numpy as np' WHEN 1 THEN 'import { a } from ''lodash'''
  ELSE 'import type { C } from ''@angular/core''' END, 'import',
  CASE lang WHEN 0 THEN 'numpy' WHEN 1 THEN 'a' ELSE 'C' END FROM f WHERE lang IN (0, 1, 7)
UNION ALL
SELECT s.repo, s.path, 4, CASE s.lang WHEN 0 THEN 'import ' || module
  WHEN 1 THEN 'import p from ''' || module || '''' ELSE 'import { P } from ''' || module || '''' END, 'import',
  CASE s.lang WHEN 0 THEN module WHEN 1 THEN 'p' ELSE 'P' END
FROM slots s WHERE lang IN (0, 1, 7) AND line = 4
UNION ALL
SELECT s.repo, s.path, 5, CASE s.lang WHEN 0 THEN 'from ' || module || ' import x'
  ELSE 'const q = require(''' || module || ''')' END,
  CASE lang WHEN 0 THEN 'from_import' ELSE 'require' END, CASE lang WHEN 0 THEN 'x' ELSE '' END
FROM slots s WHERE lang IN (0, 1) AND line = 5""")
def import_locations(spark, sf):
    return extract.import_locations(corpus(spark, sf)).withColumn(
        "names", F.array_join("imported_names", ",")).drop("imported_names")


@query("extract_all", CORPUS + f"SELECT {COLS} FROM imp")
def extract_all(spark, sf):
    return _imports(spark, sf)


@query("extractor_mode", CORPUS + """SELECT repo, source_file, count(*) AS rows FROM imp
WHERE import_type <> 'export-all' AND NOT (lang = 7 AND line_number = 3 AND import_type = 'module')
GROUP BY 1, 2""")
def extractor_mode(spark, sf):
    return _imports(spark, sf, "line").groupBy("repo", "source_file").agg(
        F.count(F.lit(1)).alias("rows"))


@query("parse_warnings", CORPUS + """
SELECT repo, path, 'Could not parse ' || path AS warning FROM f WHERE k % 9 = 0""")
def parse_warnings(spark, sf):
    # every 9th file loses its imports
    blank = F.when((F.unix_seconds("mtime") - 1700000000) % 9 == 0, "x").otherwise(F.col("content"))
    files = corpus(spark, sf).where(F.col("ext").isin(_EXT)).withColumn("content", blank)
    return extract.parse_warnings(files)


@query("register_extractor", """
WITH s AS (SELECT p_partkey AS k, p_name, p_brand FROM part)
SELECT 'parts/' || k || '.part' AS source_file, p_brand AS imported_module, 'uses' AS import_type,
       2 AS line_number FROM s WHERE p_brand <> ''""")
def register_extractor(spark, sf):
    files = table(spark, sf, "part").select(
        F.lit("parts").alias("repo"), F.concat(F.lit("parts/"), "p_partkey", F.lit(".part")).alias("path"),
        F.lit(".part").alias("ext"), F.lit(1).cast("long").alias("size_bytes"),
        F.concat_ws("\n", "p_name", F.concat(F.lit("@uses "), "p_brand")).alias("content"))
    extract.register_extractor(".part", lambda c: F.transform(
        F.filter(F.transform(F.split(c, "\n"), lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
                 lambda x: x["t"].startswith("@uses ")),
        lambda x: F.struct(x["t"].substr(F.lit(7), F.length(x["t"])).alias("module"), F.lit("uses").alias("type"),
                           (x["i"] + 1).cast("int").alias("line"))))
    got = extract.extract_imports(files, extensions=[".part"])
    extract.unregister_extractor(".part")
    return got.drop("repo", "pos")


# --- project configs ------------------------------------------------------------------------

@query("read_go_mod", CORPUS + "SELECT DISTINCT repo, 'example.com/corpus' AS go_module FROM f")
def read_go_mod(spark, sf):
    return configs.read_go_mod(corpus(spark, sf))


@query("read_js_aliases", CORPUS + "SELECT DISTINCT repo, '@/' AS alias, 'src' AS target FROM f")
def read_js_aliases(spark, sf):
    return configs.read_js_aliases(corpus(spark, sf)).select(
        "repo", F.explode("aliases").alias("a")).select("repo", "a.alias", "a.target")


@query("read_java_roots", CORPUS + "SELECT DISTINCT repo, 'src,' AS roots FROM f WHERE lang = 3")
def read_java_roots(spark, sf):
    return configs.read_java_roots(corpus(spark, sf)).select(
        "repo", F.array_join("java_roots", ",").alias("roots"))


# --- resolution -----------------------------------------------------------------------------

RES = "repo, source_file, imported_module, import_type, line_number, target, external_kind"


def _res_sql(lang: int) -> str:
    return CORPUS + f"SELECT {RES} FROM res WHERE lang = {lang}"


def _res(ext: str):
    def run(spark, sf):
        files = corpus(spark, sf)
        got = resolve.resolve_imports(extract.extract_imports(files, extensions=[ext]), files,
                                      configs.project_configs(files))
        return got.drop("lang", "pos")
    return run


for _name, _i in (("python", 0), ("js", 7), ("go", 2), ("java", 3), ("ruby", 4), ("cpp", 5), ("rust", 6)):
    query(f"resolve_{_name}", _res_sql(_i))(_res(_EXT[_i]))
query("resolve_js_relative", _res_sql(1))(_res(_EXT[1]))


@query("resolve_all", CORPUS + f"SELECT {RES} FROM res")
def resolve_all(spark, sf):
    files = corpus(spark, sf)
    return resolve.resolve_imports(
        extract.extract_imports(files), files, configs.project_configs(files)).drop("lang", "pos")


@query("classify_stdlib", CORPUS + """
SELECT lang, imported_module, count(*) AS uses FROM (
  SELECT CASE lang WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'go' WHEN 3 THEN 'java'
         ELSE 'javascript' END AS lang, imported_module FROM res WHERE external_kind = 'stdlib') GROUP BY 1, 2""")
def classify_stdlib(spark, sf):
    return _resolved(spark, sf).where("external_kind IS NOT NULL").where(
        resolve.is_stdlib("lang", "imported_module")).groupBy("lang", "imported_module").agg(
        F.count(F.lit(1)).alias("uses"))


@query("canonical_id", CORPUS + """SELECT repo, target, count(DISTINCT imported_module) AS spellings,
  count(*) AS uses FROM res GROUP BY 1, 2""")
def canonical_id(spark, sf):
    return _resolved(spark, sf).groupBy("repo", "target").agg(
        F.countDistinct("imported_module").alias("spellings"), F.count(F.lit(1)).alias("uses"))


@query("in_project", CORPUS + """
SELECT source_file, '../../../../p' || k AS target, 'package' AS external_kind
FROM (SELECT k, path AS source_file FROM f WHERE lang = 1)""")
def in_project(spark, sf):
    files = corpus(spark, sf).where("ext = '.js'")
    key = F.unix_seconds("mtime") - 1700000000
    rows = files.select("repo", F.col("path").alias("source_file"),
                        F.concat(F.lit("../../../../p"), key).alias("imported_module"),
                        F.lit("module").alias("import_type"), F.lit(1).alias("line_number"),
                        F.lit(0).alias("pos"))
    return resolve.resolve_imports(rows, files, configs.project_configs(files)).select(
        "source_file", "target", "external_kind")


@query("resolver_for", CORPUS + """SELECT repo, CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript'
  WHEN '.ts' THEN 'javascript' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.rb' THEN 'ruby'
  WHEN '.h' THEN 'cpp' ELSE 'rust' END AS lang, count(*) AS files FROM f GROUP BY 1, 2""")
def resolver_for(spark, sf):
    return corpus(spark, sf).where(F.col("ext").isin(_EXT)).groupBy(
        "repo", resolve.resolver_of_ext("ext").alias("lang")).agg(F.count(F.lit(1)).alias("files"))


@query("register_resolver", """
SELECT 'parts/' || p_partkey || '.part' AS source_file, CASE WHEN p_size IN (SELECT p_partkey FROM part) THEN
  'parts/' || p_size || '.part' ELSE 'size ' || p_size END AS target,
  CASE WHEN p_size IN (SELECT p_partkey FROM part) THEN NULL ELSE 'package' END AS external_kind FROM part""")
def register_resolver(spark, sf):
    parts = table(spark, sf, "part")
    files = parts.select(
        F.lit("parts").alias("repo"), F.concat(F.lit("parts/"), "p_partkey", F.lit(".part")).alias("path"),
        F.lit(".part").alias("ext"))
    rows = parts.select(
        F.lit("parts").alias("repo"),
        F.concat(F.lit("parts/"), "p_partkey", F.lit(".part")).alias("source_file"),
        F.concat(F.lit("size "), "p_size").alias("imported_module"), F.lit("uses").alias("import_type"),
        F.lit(1).alias("line_number"), F.lit(0).alias("pos"))
    resolve.register_resolver("partlang", lambda folder, module, cfg: F.array(F.concat(
        folder, F.lit("/"), F.substr(module, F.lit(6)), F.lit(".part"))), extensions=[".part"])
    cfg = files.select("repo", F.lit(None).cast("string").alias("go_module"),
                       F.lit(None).cast(configs.ALIASES).alias("aliases"),
                       F.lit(None).cast("array<string>").alias("java_roots")).distinct()
    got = resolve.resolve_imports(rows, files, cfg).select("source_file", "target", "external_kind")
    resolve.unregister_resolver("partlang")
    return got


# --- graph build ----------------------------------------------------------------------------

@query("build_edges", CORPUS + "SELECT repo, source, target, import_type, lines, first_line FROM ce")
def build_edges(spark, sf):
    return build.build_edges(_resolved(spark, sf)).select(
        "repo", "source", "target", "import_type", F.size("line_numbers").alias("lines"),
        F.col("line_numbers")[0].alias("first_line"))


@query("build_nodes", CORPUS + "SELECT repo, id, node_type, external_kind FROM cn")
def build_nodes(spark, sf):
    return build.build_nodes(_resolved(spark, sf))


@query("enrich_nodes", CORPUS + """,
o AS (SELECT repo, source AS id, count(*) AS c FROM ce GROUP BY 1, 2),
i AS (SELECT repo, target AS id, count(*) AS c FROM ce GROUP BY 1, 2)
SELECT repo, id, node_type, CASE WHEN node_type = 'external' THEN id ELSE regexp_extract(id, '[^/]*$') END
         AS label, coalesce(o.c, 0) AS import_count, coalesce(i.c, 0) AS imported_by_count,
       round_even(coalesce(o.c, 0) / (coalesce(o.c, 0) + coalesce(i.c, 0)), 4) AS instability,
       coalesce(x.r, 0) AS external_ratio
FROM cn LEFT JOIN o USING (repo, id) LEFT JOIN i USING (repo, id)
LEFT JOIN (SELECT ce.repo, source AS id, round_even(avg(CASE WHEN node_type = 'external' THEN 1.0 ELSE 0 END), 4) AS r
           FROM ce JOIN cn ON cn.repo = ce.repo AND cn.id = target GROUP BY 1, 2) x USING (repo, id)""")
def enrich_nodes(spark, sf):
    n, e = corpus_graph(spark, sf)
    return build.enrich_nodes(n, e, {"external_ratio": build.external_ratio(n, e)}).drop("external_kind")


@query("file_stats", CORPUS + """SELECT repo, id, 6 + CASE WHEN id LIKE '%.go' THEN 1 ELSE 0 END AS line_count
FROM cn WHERE node_type <> 'external' AND id LIKE '%.%'
UNION ALL SELECT repo, id, NULL FROM cn WHERE node_type <> 'external' AND id NOT LIKE '%.%'""")
def file_stats(spark, sf):
    n, _ = corpus_graph(spark, sf)
    return build.file_stats(n, corpus(spark, sf)).select("repo", "id", "line_count")


COMMITS = """, commits AS (
  SELECT 'r' || (o_custkey % 3) AS repo, 'c' || (o_custkey % 400) AS path, CAST(o_orderkey AS VARCHAR) AS rev,
         sha256(CAST(o_orderkey AS VARCHAR)) AS hash, o_orderpriority AS subject,
         'customer ' || o_custkey AS author_name, 'c' || o_custkey || '@example.com' AS author_email,
         o_orderdate AS ts FROM orders),
last_commit AS (SELECT repo, path, hash, subject, author_name, author_email, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY ts DESC, hash DESC) AS rn FROM commits)
  WHERE rn = 1)"""


def commits(spark, sf):
    cust = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("r"), cust % 3).alias("repo"), F.concat(F.lit("c"), cust % 400).alias("path"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"),
        F.col("o_orderpriority").alias("subject"),
        F.concat(F.lit("customer "), cust).alias("author_name"),
        F.concat(F.lit("c"), cust, F.lit("@example.com")).alias("author_email"),
        F.col("o_orderdate").alias("ts"))


@query("scan_commits", CORPUS + COMMITS + "SELECT * FROM last_commit")
def scan_commits(spark, sf):
    return build.latest_commits(commits(spark, sf))


@query("commit_join", CORPUS + COMMITS + """
SELECT f.repo, 'c' || (k % 400) AS id, hash AS commit_hash FROM (
  SELECT DISTINCT repo, k % 400 AS k FROM f) f LEFT JOIN last_commit l ON l.repo = f.repo AND l.path = 'c' || k""")
def commit_join(spark, sf):
    k = F.col("p_partkey")
    nodes = table(spark, sf, "part").select(
        F.concat(F.lit("r"), k % 3).alias("repo"), F.concat(F.lit("c"), k % 400).alias("id"),
        F.lit("module").alias("node_type")).distinct()
    return build.commit_join(nodes, commits(spark, sf))


@query("scan_packages", """
SELECT 'Supplier#' || CAST(s_suppkey AS VARCHAR) || '.core' AS id, 'v' || s_nationkey AS version
FROM supplier""")
def scan_packages(spark, sf):
    s = table(spark, sf, "supplier")
    name = F.concat(F.lit("Supplier#"), "s_suppkey")
    nodes = s.select(F.lit("r").alias("repo"), F.concat(name, F.lit(".core")).alias("id"),
                     F.lit("package").alias("external_kind"))
    versions = s.select(name.alias("name"), F.concat(F.lit("v"), "s_nationkey").alias("version"))
    return build.package_versions(nodes, versions).drop("repo")


@query("capture_contents", CORPUS + f"""
SELECT f.repo, path AS key, {_sql_list(_HEAD)} AS first_line, {_sql_list(_TAIL)} AS last_line
FROM f JOIN (SELECT repo, id FROM cn WHERE node_type <> 'external') n ON n.repo = f.repo AND n.id = path""")
def capture_contents(spark, sf):
    n, _ = corpus_graph(spark, sf)
    return build.capture_contents(n, corpus(spark, sf)).select(
        "repo", "key", F.substring_index("content", "\n", 1).alias("first_line"),
        F.substring_index(F.rtrim("content", F.lit("\n")), "\n", -1).alias("last_line"))


@query("edges_from_analysis", CORPUS + """
SELECT repo, count(*) AS edges, count(DISTINCT source) AS sources FROM ce GROUP BY 1""")
def edges_from_analysis(spark, sf):
    from srcgraph.sinks.store import save_analysis
    from srcgraph.sources.store import edges_from_analysis as load
    from srcgraph.stage import Stage
    n, e = corpus_graph(spark, sf)
    root = Stage(spark, "store").root
    save_analysis(root, "one", {"nodes": n, "edges": e})
    save_analysis(root, "two", {"nodes": n, "edges": e.where("source < target")})
    save_analysis(root, "one", {"nodes": n, "edges": e})
    return load(spark, root, "one")[1].groupBy("repo").agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("source").alias("sources"))


# --- languages ------------------------------------------------------------------------------

LANGS = CORPUS + """, lc AS (
  SELECT repo, CASE ext WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript'
    WHEN '.go' THEN 'Go' WHEN '.java' THEN 'Java' WHEN '.rb' THEN 'Ruby' WHEN '.h' THEN 'C/C++' ELSE 'Rust' END
    AS language, count(*) AS files FROM f GROUP BY 1, 2)"""


@query("detect_languages", LANGS + "SELECT * FROM lc")
def detect_languages(spark, sf):
    return languages.detect_languages(corpus(spark, sf))


@query("language_of_ext", LANGS + "SELECT repo, language, files FROM lc")
def language_of_ext(spark, sf):
    return corpus(spark, sf).select("repo", languages.language_of_ext("ext").alias("language")).where(
        "language IS NOT NULL").groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"))


@query("language_breakdown", LANGS + """
SELECT repo, language, files, round_even(files / t * 100, 2) AS percentage, t AS total_files,
       p AS primary_language
FROM lc JOIN (SELECT repo, sum(files)::BIGINT AS t FROM lc GROUP BY 1) USING (repo)
JOIN (SELECT repo, language AS p FROM (SELECT *, row_number() OVER (
  PARTITION BY repo ORDER BY files DESC, language) AS rn FROM lc) WHERE rn = 1) USING (repo)""")
def language_breakdown(spark, sf):
    return languages.language_breakdown(corpus(spark, sf))


@query("is_multi_language", LANGS + """
SELECT repo, count(*) FILTER (files >= 84) > 1 AS is_multi_language FROM lc GROUP BY 1""")
def is_multi_language(spark, sf):
    return languages.is_multi_language(corpus(spark, sf), 84)


@query("supported_languages", CORPUS + """
SELECT DISTINCT CASE ext WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript'
    WHEN '.go' THEN 'Go' WHEN '.java' THEN 'Java' WHEN '.rb' THEN 'Ruby' WHEN '.h' THEN 'C/C++' ELSE 'Rust' END
    AS language, CASE ext WHEN '.py' THEN 2 WHEN '.js' THEN 4 WHEN '.ts' THEN 2 WHEN '.h' THEN 7 ELSE 1 END
    AS extensions FROM f""")
def supported_languages(spark, sf):
    count = {}
    for family in languages.FAMILY_OF_EXT.values():
        name = languages.FAMILY_NAMES[family]
        count[name] = count.get(name, 0) + 1
    count = {name: str(n) for name, n in count.items()}
    family = languages.lookup(languages.family_of_ext("ext"), languages.FAMILY_NAMES)
    return corpus(spark, sf).where(F.col("ext").isin(_EXT)).select(family.alias("language")).distinct(
    ).withColumn("extensions", languages.lookup("language", count).cast("long"))


# --- ids ------------------------------------------------------------------------------------

@query("project_fingerprint", CORPUS + """,
entries AS (
  SELECT repo, path, 1700000000 + k AS tm FROM f
  UNION ALL SELECT DISTINCT repo, 'go.mod', 1700000000 FROM f
  UNION ALL SELECT DISTINCT repo, 'tsconfig.json', 1700000000 FROM f),
leaf AS (SELECT repo, ('0x' || md5(path)[1:8])::BIGINT % 4096 AS bucket,
  sha256(string_agg(path || ':' || (tm * 1000000), '' ORDER BY path || ':' || (tm * 1000000))) AS digest
  FROM entries GROUP BY 1, 2)
SELECT repo, 'local-project-' || sha256(string_agg(digest, '' ORDER BY bucket))[1:16] AS fingerprint
FROM leaf GROUP BY 1""")
def project_fingerprint(spark, sf):
    return urls.project_fingerprint(corpus(spark, sf))


@query("folder_path", CORPUS + "SELECT repo, folder, count(*) AS files FROM f GROUP BY 1, 2")
def folder_path_query(spark, sf):
    return corpus(spark, sf).where(F.col("ext").isin(_EXT)).groupBy(
        "repo", folder_path("path").alias("folder")).agg(F.count(F.lit(1)).alias("files"))
