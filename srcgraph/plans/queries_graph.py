"""Queries on the month and region graphs: degrees, centralities, cycles, impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcgraph.operators import (
    build, centrality, components, cycles, impact, insights, metrics, spectral, traverse)
from srcgraph.plans.registry import query
from srcgraph.plans.views import PARTS, REGIONS, parts, regions
from srcgraph.stage import Stage, staged_once

# PageRank rounds until a repo's change is below nodes * 1e-6; rounded, so that ties are ties in both engines
RANK = """outdeg AS (SELECT source AS id, count(*) AS d FROM e GROUP BY 1),
nn AS MATERIALIZED (SELECT repo, CAST(count(*) AS DOUBLE) AS c FROM n GROUP BY 1),
rounds(i, repo, id, c, r, done) AS (
  SELECT 0, repo, id, c, 1 / c, false FROM n JOIN nn USING (repo)
  UNION ALL
  SELECT i + 1, repo, id, c, fresh, sum(abs(fresh - r)) OVER (PARTITION BY repo) < c * 1e-6 FROM (
    SELECT w.i, w.repo, w.id, w.c, w.r, 0.85 * (coalesce(x.s, 0) + sum(CASE WHEN o.d IS NULL THEN w.r ELSE 0 END)
      OVER (PARTITION BY w.repo) / w.c) + 0.15 / w.c AS fresh
    FROM rounds w LEFT JOIN outdeg o ON o.id = w.id LEFT JOIN (
      SELECT e.target AS id, sum(p.r / q.d) AS s
      FROM e JOIN rounds p ON p.id = e.source JOIN outdeg q ON q.id = e.source GROUP BY 1) x ON x.id = w.id
    WHERE NOT w.done)),
pr AS MATERIALIZED (SELECT repo, id, round(r, 12) AS r FROM rounds WHERE done)"""
# distance of every node from the nodes that nothing imports
ENTRY = """entry AS (SELECT id FROM n WHERE id NOT IN (SELECT target FROM e)),
walk(id, dist) AS (
  SELECT id, 0 FROM entry
  UNION SELECT e.target, walk.dist + 1 FROM walk JOIN e ON e.source = walk.id, lim WHERE walk.dist < lim.c),
near AS (SELECT id, min(dist) AS dist FROM walk GROUP BY 1)"""
# closure of the internal sub-graph
CLOSURE = """ie AS (SELECT source, target FROM e WHERE source % 10 <> 0 AND target % 10 <> 0),
tc(a, b) AS (SELECT source, target FROM ie
             UNION SELECT tc.a, ie.target FROM tc JOIN ie ON ie.source = tc.b),
mutual AS (SELECT x.a, x.b FROM tc x JOIN tc y ON y.a = x.b AND y.b = x.a),
comp AS (SELECT n.id, coalesce(min(m.b), n.id) AS scc
         FROM n LEFT JOIN mutual m ON m.a = n.id WHERE n.id % 10 <> 0 GROUP BY n.id)"""
# elementary cycles, starting at their smallest node
RINGS = """mutual_e AS (SELECT source, target FROM e),
trail(start, last, path) AS (
  SELECT source, target, [source, target] FROM mutual_e WHERE source < target
  UNION ALL
  SELECT t.start, m.target, list_append(t.path, m.target)
  FROM trail t JOIN mutual_e m ON m.source = t.last
  WHERE m.target > t.start AND NOT list_contains(t.path, m.target)),
rings AS (SELECT path AS cycle, len(path) AS length FROM trail t
          JOIN mutual_e m ON m.source = t.last AND m.target = t.start)"""
ASKED = "asked AS (SELECT repo, id FROM n)"
HITS = """hop(origin, id, dist) AS (
  SELECT id, id, 0 FROM asked
  UNION SELECT h.origin, e.source, h.dist + 1 FROM hop h JOIN e ON e.target = h.id, lim WHERE h.dist < lim.c),
hits AS (SELECT origin, id, min(dist) AS dist FROM hop WHERE id <> origin GROUP BY 1, 2)"""


def _rank(spark, sf):
    """The scores that several queries read, computed once per session."""
    return staged_once(spark, "part_rank", sf, lambda: spectral.pagerank(
        *parts(spark, sf)).withColumn("pagerank", F.round("pagerank", 12)))


def _asked(nodes):
    return nodes.select("repo", "id")


@query("degrees", PARTS + "SELECT repo, id, import_count, imported_by_count FROM deg")
def degrees(spark, sf):
    return build.degrees(*parts(spark, sf))


@query("instability", PARTS + """SELECT id, CASE WHEN import_count + imported_by_count > 0
  THEN round_even(import_count / (import_count + imported_by_count), 4) ELSE 0 END AS instability FROM deg""")
def instability(spark, sf):
    return build.instability(build.degrees(*parts(spark, sf))).select("id", "instability")


@query("labels", PARTS + """SELECT id, CASE WHEN node_type = 'external' THEN CAST(id AS VARCHAR)
  ELSE regexp_extract(file_path, '[^/]*$') END AS label FROM n""")
def labels(spark, sf):
    n, _ = parts(spark, sf)
    named = n.select(F.col("id").alias("key"), F.when(
        F.col("node_type") == "external", F.col("id").cast("string")).otherwise(F.col("file_path"))
        .alias("id"), "node_type")
    return build.labels(named).select(F.col("key").alias("id"), "label")


@query("pagerank", PARTS + "," + RANK + " SELECT id, round(r, 9) AS pagerank FROM pr")
def pagerank(spark, sf):
    return spectral.pagerank(*parts(spark, sf)).select("id", F.round("pagerank", 9).alias("pagerank"))


@query("hub_modules", PARTS + "," + RANK + """
SELECT row_number() OVER (PARTITION BY repo ORDER BY r DESC, id) AS rank, id, round(r, 9) AS pagerank FROM pr
QUALIFY rank <= 5""")
def hub_modules(spark, sf):
    return metrics.hub_modules(_rank(spark, sf)).select(
        "rank", "id", F.round("pagerank", 9).alias("pagerank"))


@query("top_nodes", PARTS + "," + RANK + """
SELECT row_number() OVER (PARTITION BY n.repo ORDER BY r DESC, id) AS rank, id, label FROM pr JOIN n USING (id)
QUALIFY rank <= 10""")
def top_nodes(spark, sf):
    from srcgraph.operators.explore import top_nodes as top
    n, _ = parts(spark, sf)
    # the few first nodes are a table of their own, so that the others do not travel
    first, _ = Stage(spark, "top_nodes").save(top(_rank(spark, sf), 10).select("repo", "id", "rank"))
    return n.join(first, ["repo", "id"]).select("rank", "id", "label")


EIGEN = """, rounds(i, repo, id, c, r, done) AS (
  SELECT 0, repo, id, CAST(count(*) OVER (PARTITION BY repo) AS DOUBLE), 1.0 / count(*) OVER (PARTITION BY repo), false
  FROM n
  UNION ALL
  SELECT i + 1, repo, id, c, fresh, sum(abs(fresh - r)) OVER (PARTITION BY repo) < c * 1e-6 FROM (
    SELECT i, repo, id, c, r, y / sqrt(sum(y * y) OVER (PARTITION BY repo)) AS fresh FROM (
      SELECT w.i, w.repo, w.id, w.c, w.r, w.r + coalesce(x.s, 0) AS y FROM rounds w LEFT JOIN (
        SELECT e.source AS id, sum(p.r) AS s FROM e JOIN rounds p ON p.id = e.target GROUP BY 1) x ON x.id = w.id
      WHERE NOT w.done)))
SELECT id, round(r, 8) AS eigenvector FROM rounds WHERE done"""


@query("eigenvector", PARTS + EIGEN)
def eigenvector(spark, sf):
    return spectral.eigenvector(*parts(spark, sf)).select(
        "id", F.round("eigenvector", 8).alias("eigenvector"))


@query("indegree_centrality", PARTS + """SELECT id,
  round(imported_by_count / max(imported_by_count) OVER (PARTITION BY repo), 9) AS indegree_centrality FROM deg""")
def indegree_centrality(spark, sf):
    return spectral.indegree_centrality(*parts(spark, sf)).select(
        "id", F.round("indegree_centrality", 9).alias("indegree_centrality"))


PATHS = """, hop(s, id, dist) AS (
  SELECT id, id, 0 FROM n
  UNION SELECT h.s, e.target, h.dist + 1 FROM hop h JOIN e ON e.source = h.id, lim WHERE h.dist < lim.c),
d AS MATERIALIZED (SELECT s, id, min(dist) AS dist FROM hop GROUP BY 1, 2)"""
BETWEEN = PATHS + """, line(s, t, path) AS (
  SELECT id, id, [id] FROM n
  UNION ALL
  SELECT l.s, e.target, list_append(l.path, e.target)
  FROM line l JOIN e ON e.source = l.t JOIN d ON d.s = l.s AND d.id = e.target
  WHERE d.dist = len(l.path)),
sigma AS (SELECT s, t, count(*) AS c FROM line GROUP BY 1, 2),
inner_node AS (SELECT s, t, unnest(path[2:len(path) - 1]) AS id FROM line WHERE len(path) > 2),
dep AS (SELECT i.id, sum(1.0 / c) AS b FROM inner_node i JOIN sigma USING (s, t) GROUP BY 1)
SELECT n.id, CASE WHEN sz.c > 2 THEN round(coalesce(b, 0) / (sz.c - 1) / (sz.c - 2), 8) ELSE 0 END
  AS betweenness FROM n JOIN (SELECT repo, count(*) AS c FROM n GROUP BY 1) sz USING (repo) LEFT JOIN dep USING (id)"""


@query("betweenness", PARTS + BETWEEN)
def betweenness(spark, sf):
    return centrality.betweenness(*parts(spark, sf)).select(
        "id", F.round("betweenness", 8).alias("betweenness"))


@query("betweenness_sampled", PARTS + PATHS + """, chosen AS (
  SELECT id FROM n QUALIFY row_number() OVER (PARTITION BY repo ORDER BY md5(CAST(id AS VARCHAR)), id) <= 8), line(s, t, path) AS (
  SELECT id, id, [id] FROM chosen
  UNION ALL
  SELECT l.s, e.target, list_append(l.path, e.target)
  FROM line l JOIN e ON e.source = l.t JOIN d ON d.s = l.s AND d.id = e.target
  WHERE d.dist = len(l.path)),
sigma AS (SELECT s, t, count(*) AS c FROM line GROUP BY 1, 2),
inner_node AS (SELECT s, t, unnest(path[2:len(path) - 1]) AS id FROM line WHERE len(path) > 2),
dep AS (SELECT i.id, sum(1.0 / c) AS b FROM inner_node i JOIN sigma USING (s, t) GROUP BY 1)
SELECT n.id, CASE WHEN sz.c > 2 THEN round(coalesce(b, 0) / (sz.c - 1) / (sz.c - 2) * sz.c / least(sz.c, 8), 8)
  ELSE 0 END AS betweenness
FROM n JOIN (SELECT repo, count(*) AS c FROM n GROUP BY 1) sz USING (repo) LEFT JOIN dep USING (id)""")
def betweenness_sampled(spark, sf):
    return centrality.betweenness(*parts(spark, sf), k=8).select(
        "id", F.round("betweenness", 8).alias("betweenness"))


@query("closeness", PARTS + PATHS + """, r AS (
  SELECT s AS id, count(*) AS r, sum(dist) AS total FROM d GROUP BY 1)
SELECT id, CASE WHEN total > 0 THEN round((r.r - 1) / total * ((r.r - 1) / (sz.c - 1)), 8)
  ELSE 0 END AS closeness FROM r JOIN n USING (id) JOIN (SELECT repo, count(*) AS c FROM n GROUP BY 1) sz USING (repo)""")
def closeness(spark, sf):
    return centrality.closeness(*parts(spark, sf)).select(
        "id", F.round("closeness", 8).alias("closeness"))


@query("node_importance", PARTS + "," + RANK + BETWEEN.replace(
    "SELECT n.id, CASE", ", bt AS (SELECT n.id, CASE") + """)
SELECT id, round(r, 9) AS pagerank, betweenness,
       imported_by_count, import_count
FROM deg JOIN pr USING (id) JOIN bt USING (id)""")
def node_importance(spark, sf):
    n, e = parts(spark, sf)
    scored = (
        build.degrees(n, e).join(_rank(spark, sf), ["repo", "id"])
        .join(centrality.betweenness(n, e), ["repo", "id"]))
    return metrics.node_importance(scored, scored.select("repo", "id")).select(
        "id", F.round("pagerank", 9).alias("pagerank"), F.round("betweenness", 8).alias("betweenness"),
        "imported_by_count", "import_count")


@query("scc", PARTS + "," + CLOSURE + " SELECT id, scc FROM comp")
def scc(spark, sf):
    inner, links = components.internal(*parts(spark, sf))
    return components.scc(inner, links).select("id", "scc")


@query("largest_scc", PARTS + "," + CLOSURE + """
SELECT repo, max(c) AS largest_scc_size FROM (
  SELECT repo, count(*) AS c FROM comp JOIN n USING (id) GROUP BY repo, scc) GROUP BY 1""")
def largest_scc(spark, sf):
    return components.largest_scc(*parts(spark, sf))


def _rings(spark, sf):
    """The cycles that several queries read, computed once per session."""
    return staged_once(spark, "part_rings", sf, lambda: cycles.simple_cycles(
        *parts(spark, sf))[0])


@query("simple_cycles", PARTS + "," + RINGS + """
SELECT array_to_string(cycle, '>') AS cycle, length FROM rings""")
def simple_cycles(spark, sf):
    return _rings(spark, sf).select(F.array_join(F.transform(
        "cycle", lambda x: x.cast("string")), ">").alias("cycle"), "length")


@query("simple_cycles_regions", REGIONS + "," + RINGS + """
SELECT array_to_string(cycle, '>') AS cycle, length FROM rings""")
def simple_cycles_regions(spark, sf):
    return cycles.simple_cycles(*regions(spark, sf))[0].select(
        F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"), "length")


@query("cycle_participation", PARTS + "," + RINGS + """
SELECT n.id, coalesce(c, 0) AS cycle_count FROM n LEFT JOIN (
  SELECT unnest(cycle) AS id, count(*) AS c FROM rings GROUP BY 1) USING (id)""")
def cycle_participation(spark, sf):
    n, _ = parts(spark, sf)
    return cycles.cycle_participation(n, _rings(spark, sf)).select("id", "cycle_count")


@query("cycle_details", PARTS + "," + RINGS + """,
own AS (SELECT repo, cycle, length FROM rings JOIN n ON n.id = cycle[1]),
ten AS (SELECT cycle, length, row_number() OVER (PARTITION BY repo ORDER BY length, cycle) AS rank FROM own
        QUALIFY rank <= 10),
step AS (SELECT rank, length, cycle[i] AS source, cycle[i % length + 1] AS target, i
         FROM ten, LATERAL (SELECT unnest(range(1, length + 1)) AS i))
SELECT rank, length, CASE WHEN length <= 3 THEN 'high' ELSE 'medium' END AS severity, source, target,
       import_type, line_1 || ',' || line_2 AS lines
FROM step JOIN e USING (source, target)""")
def cycle_details(spark, sf):
    _, e = parts(spark, sf)
    return cycles.cycle_details(_rings(spark, sf), e, 10).select(
        "rank", "length", "severity", F.explode("edges").alias("x")).select(
        "rank", "length", "severity", "x.source", "x.target", "x.import_type",
        F.array_join(F.transform("x.line_numbers", lambda v: v.cast("string")), ",").alias("lines"))


@query("cycle_warnings", PARTS + "," + RINGS + """
SELECT row_number() OVER (PARTITION BY repo ORDER BY length, cycle) AS rank, array_to_string(cycle, ' → ') AS warning
FROM rings JOIN n ON n.id = cycle[1] QUALIFY rank <= 5""")
def cycle_warnings(spark, sf):
    return cycles.cycle_warnings(_rings(spark, sf), 5).select("rank", "warning")


@query("cycle_stats", PARTS + "," + RINGS + """
SELECT repo, count(*) AS total_cycles, round_even(avg(length), 1) AS avg_cycle_length,
       max(length) AS max_cycle_length FROM rings JOIN n ON n.id = cycle[1] GROUP BY 1""")
def cycle_stats(spark, sf):
    return cycles.cycle_stats(_rings(spark, sf))


@query("node_depth", PARTS + "," + ENTRY + """
SELECT n.id, coalesce(dist, 0) AS depth FROM n LEFT JOIN near USING (id)""")
def node_depth(spark, sf):
    return traverse.node_depth(*parts(spark, sf)).select("id", "depth")


@query("max_depth", PARTS + """, from_each(origin, id, dist) AS (
  SELECT id, id, 0 FROM n WHERE id NOT IN (SELECT target FROM e)
  UNION SELECT f.origin, e.target, f.dist + 1 FROM from_each f JOIN e ON e.source = f.id, lim
        WHERE f.dist < lim.c)
SELECT n.repo, coalesce(max(d), 0) AS max_import_depth
FROM n LEFT JOIN (SELECT origin, id, min(dist) AS d FROM from_each GROUP BY 1, 2) USING (id) GROUP BY 1""")
def max_depth(spark, sf):
    return traverse.max_depth(*parts(spark, sf))


@query("isolated", PARTS + """, lone AS (
  SELECT id FROM n WHERE node_type <> 'external'
   AND id NOT IN (SELECT source FROM e WHERE target % 10 <> 0)
   AND id NOT IN (SELECT target FROM e WHERE source % 10 <> 0)) SELECT id FROM lone""")
def isolated(spark, sf):
    # the internal sub-graph alone, as an imported graph would be
    n, e = components.internal(*parts(spark, sf))
    return metrics.isolated(n, e).select("id")


@query("entry_points", PARTS + """
SELECT id FROM n WHERE node_type <> 'external' AND id NOT IN (SELECT target FROM e)""")
def entry_points(spark, sf):
    return metrics.entry_points(*parts(spark, sf)).select("id")


DENSITY = """SELECT repo, CASE WHEN c > 1 THEN round_even(m / (c * (c - 1)), 4) ELSE 0 END AS graph_density
  FROM (SELECT repo, count(*) AS c FROM n GROUP BY 1) JOIN (SELECT repo, count(*) AS m FROM e GROUP BY 1)
  USING (repo)"""


@query("density", PARTS + DENSITY)
def density(spark, sf):
    return metrics.density(*parts(spark, sf))


@query("external_ratio", PARTS + """
SELECT n.id, coalesce(round_even(x.r, 4), 0) AS external_ratio FROM n LEFT JOIN (
  SELECT source AS id, avg(CASE WHEN target % 10 = 0 THEN 1.0 ELSE 0.0 END) AS r FROM e GROUP BY 1) x
USING (id)""")
def external_ratio(spark, sf):
    return build.external_ratio(*parts(spark, sf)).select("id", "external_ratio")


COUNTS = """SELECT repo, total_files, external_node_count, total_edges, internal_edges, external_edges_ratio
FROM (SELECT repo, count(*) FILTER (node_type <> 'external') AS total_files,
        count(*) FILTER (node_type = 'external') AS external_node_count FROM n GROUP BY 1)
JOIN (SELECT repo, count(*) AS total_edges,
        count(*) FILTER (source % 10 <> 0 AND target % 10 <> 0) AS internal_edges,
        round_even(count(*) FILTER (target % 10 = 0) / count(*), 4) AS external_edges_ratio FROM e GROUP BY 1)
USING (repo)"""


@query("edge_counts", PARTS + COUNTS)
def edge_counts(spark, sf):
    return metrics.edge_counts(*parts(spark, sf))


@query("external_edges_ratio", PARTS + "SELECT repo, external_edges_ratio FROM (" + COUNTS + ")")
def external_edges_ratio(spark, sf):
    return metrics.edge_counts(*parts(spark, sf)).select("repo", "external_edges_ratio")


STATISTICS = """SELECT repo, round_even(coalesce(avg(import_count), 0), 2) AS avg_imports_per_file,
  coalesce(max(import_count), 0) AS max_imports_in_file,
  coalesce(CAST(arg_min(id, -import_count * 1000000000000 + id) AS VARCHAR), '') AS max_imports_file,
  coalesce(CAST(arg_min(id, -imported_by_count * 1000000000000 + id) AS VARCHAR), '') AS most_imported_module,
  coalesce(max(imported_by_count), 0) AS most_imported_count
FROM (SELECT DISTINCT repo FROM n) LEFT JOIN (SELECT * FROM deg WHERE node_type <> 'external') USING (repo) GROUP BY 1"""


@query("import_statistics", PARTS + STATISTICS)
def import_statistics(spark, sf):
    return metrics.import_statistics(*parts(spark, sf))


@query("top_importers", PARTS + """
SELECT row_number() OVER (PARTITION BY repo ORDER BY import_count DESC, id) AS rank, id, import_count FROM deg
QUALIFY rank <= 5""")
def top_importers(spark, sf):
    return metrics.top_importers(*parts(spark, sf)).drop("repo")


@query("top_imported", PARTS + """
SELECT row_number() OVER (PARTITION BY repo ORDER BY imported_by_count DESC, id) AS rank, id, imported_by_count FROM deg
QUALIFY rank <= 5""")
def top_imported(spark, sf):
    return metrics.top_imported(*parts(spark, sf)).drop("repo")


def _per_repo(name: str, value: str, source: str) -> str:
    return f"(SELECT repo, {value} AS {name} FROM {source} GROUP BY 1)"


REPORT = PARTS + "," + RANK + "," + CLOSURE + "," + RINGS + f""",
from_each(origin, id, dist) AS (
  SELECT id, id, 0 FROM n WHERE id NOT IN (SELECT target FROM e)
  UNION SELECT f.origin, e.target, f.dist + 1 FROM from_each f JOIN e ON e.source = f.id, lim
        WHERE f.dist < lim.c),
lone AS (SELECT repo FROM deg WHERE node_type <> 'external' AND import_count = 0 AND imported_by_count = 0),
first AS (SELECT repo FROM deg WHERE node_type <> 'external' AND imported_by_count = 0),
far AS (SELECT repo, min(dist) AS d FROM from_each JOIN n USING (id) GROUP BY repo, origin, id),
own AS (SELECT repo, length FROM rings JOIN n ON n.id = cycle[1]),
big AS (SELECT repo, count(*) AS c FROM comp JOIN n USING (id) GROUP BY repo, scc),
hub AS (SELECT repo, id, r FROM pr QUALIFY row_number() OVER (PARTITION BY repo ORDER BY r DESC, id) <= 5),
rep AS (
SELECT repo, counts.* EXCLUDE (repo), stats.* EXCLUDE (repo), graph_density,
  coalesce(isolated_count, 0) AS isolated_count, coalesce(entry_points_count, 0) AS entry_points_count,
  coalesce(max_import_depth, 0) AS max_import_depth, coalesce(total_cycles, 0) AS total_cycles,
  coalesce(avg_cycle_length, 0) AS avg_cycle_length, coalesce(max_cycle_length, 0) AS max_cycle_length,
  coalesce(largest_scc_size, 0) AS largest_scc_size, hubs
FROM ({COUNTS}) counts JOIN ({STATISTICS}) stats USING (repo) JOIN ({DENSITY}) USING (repo)
  LEFT JOIN {_per_repo("isolated_count", "count(*)", "lone")} USING (repo)
  LEFT JOIN {_per_repo("entry_points_count", "count(*)", "first")} USING (repo)
  LEFT JOIN {_per_repo("max_import_depth", "max(d)", "far")} USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS total_cycles, round_even(avg(length), 1) AS avg_cycle_length,
                    max(length) AS max_cycle_length FROM own GROUP BY 1) USING (repo)
  LEFT JOIN {_per_repo("largest_scc_size", "max(c)", "big")} USING (repo)
  LEFT JOIN {_per_repo("hubs", "string_agg(CAST(id AS VARCHAR), ',' ORDER BY r DESC, id)", "hub")} USING (repo))
"""
REPORT_COLUMNS = [
    "repo", "total_files", "external_node_count", "total_edges", "internal_edges",
    "external_edges_ratio", "avg_imports_per_file", "max_imports_in_file", "max_imports_file",
    "most_imported_module", "most_imported_count", "graph_density", "isolated_count",
    "entry_points_count", "max_import_depth", "total_cycles", "avg_cycle_length", "max_cycle_length",
    "largest_scc_size", "hubs",
]


def report_of(spark, sf):
    n, e = parts(spark, sf)
    return staged_once(spark, "part_metrics", sf, lambda: metrics.metrics_report(
        n, e, "full", _rank(spark, sf)))


@query("metrics_report", REPORT + "SELECT " + ", ".join(REPORT_COLUMNS) + " FROM rep")
def metrics_report(spark, sf):
    return report_of(spark, sf).withColumn("hubs", F.array_join(F.transform(
        "hub_modules", lambda m: m["module"]), ",")).select(*REPORT_COLUMNS)


@query("metrics_report_light", REPORT + """SELECT repo, total_files, total_edges, graph_density,
  isolated_count, entry_points_count, max_import_depth, 0 AS total_cycles FROM rep""")
def metrics_report_light(spark, sf):
    n, e = parts(spark, sf)
    return metrics.metrics_report(n, e, "light").select(
        "repo", "total_files", "total_edges", "graph_density", "isolated_count",
        "entry_points_count", "max_import_depth", "total_cycles")


def _health_view(spark, sf):
    return report_of(spark, sf)


HEALTH = REPORT + """, m AS (SELECT repo, total_cycles AS c, max_import_depth AS d,
  isolated_count AS i, total_files, hubs FROM rep),
s AS (SELECT *, greatest(0, least(100, 100 - least(c * 5, 30) - greatest(d - 10, 0) * 2)) AS score FROM m),
iss AS (
  SELECT repo, 'circular_dependencies' AS type, CASE WHEN c > 5 THEN 'high' ELSE 'medium' END AS severity,
         c AS count, 'Found ' || c || ' circular dependencies' AS message FROM m WHERE c > 0
  UNION ALL SELECT repo, 'deep_imports', 'medium', d, 'Maximum import depth is ' || d FROM m WHERE d > 10
  UNION ALL SELECT repo, 'isolated_modules', 'low', i, 'Found ' || i || ' isolated modules' FROM m
            WHERE i > 0)
"""
STATUS = ("CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' "
          "WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS health_status")


@query("health_score", HEALTH + f"SELECT repo, score AS health_score, {STATUS} FROM s")
def health_score(spark, sf):
    return insights.health(_health_view(spark, sf))


@query("issues", HEALTH + "SELECT * FROM iss")
def issues(spark, sf):
    return insights.issues(_health_view(spark, sf))


@query("recommendations", HEALTH + """
SELECT repo, 'architecture' AS category, 'high' AS priority, 'Break circular dependencies' AS title,
  'Circular dependencies make code harder to test and maintain. Consider refactoring to break these cycles.'
    AS description
FROM m WHERE c > 0
UNION ALL SELECT repo, 'architecture', 'medium', 'Reduce import depth',
  'Deep import chains can indicate overly complex dependencies. Consider flattening your module structure.'
FROM m WHERE d > 10
UNION ALL SELECT repo, 'testing', 'high', 'Focus testing on hub modules', 'The top 5 most important modules are: '
  || replace(hubs, ',', ', ') || '. These should have comprehensive tests.' FROM m""")
def recommendations(spark, sf):
    return insights.recommendations(_health_view(spark, sf))


@query("insights", HEALTH + f"""
SELECT repo, score AS health_score, {STATUS}, total_files, c AS circular_dependencies,
       i AS isolated_modules, d AS max_depth,
       CASE WHEN severity IN ('high', 'medium') THEN 'warning' WHEN severity IS NOT NULL THEN 'info' END AS type,
       message AS title, message AS description, severity
FROM s LEFT JOIN iss USING (repo)""")
def insights_query(spark, sf):
    return insights.insights(_health_view(spark, sf))


@query("gate_score", HEALTH + """
SELECT repo, greatest(0, least(100, 100 - c * 5 - greatest(d - 10, 0) * 2)) AS gate_score FROM m""")
def gate_score(spark, sf):
    return _health_view(spark, sf).select("repo", insights.gate_score().alias("gate_score"))


@query("quality_gate", HEALTH + """
SELECT repo, c <= 1 AS cycles_ok, d <= 20 AS depth_ok, c <= 1 AND d <= 20 AS passed FROM m""")
def quality_gate(spark, sf):
    return insights.quality_gate(_health_view(spark, sf), 1, 20)


@query("k_hop", PARTS + "," + ASKED + "," + HITS + " SELECT origin, id, dist FROM hits")
def k_hop(spark, sf):
    n, e = parts(spark, sf)
    return traverse.k_hop(e, _asked(n)).drop("repo")


@query("affected_files", PARTS + "," + RANK + "," + ASKED + "," + HITS + """
SELECT origin AS target, h.id AS file_path, dist AS distance,
       CASE WHEN dist = 1 THEN 'direct' ELSE 'transitive' END AS impact_type,
       round(r, 9) AS pagerank, imported_by_count
FROM hits h JOIN pr ON pr.id = h.id JOIN deg ON deg.id = h.id""")
def affected_files(spark, sf):
    n, e = parts(spark, sf)
    got = impact.affected_files(n, e, _asked(n), _rank(spark, sf))
    return got.drop("repo").withColumn("pagerank", F.round("pagerank", 9))


SCORES = PARTS + "," + RANK + "," + ASKED + "," + HITS + """,
agg AS (SELECT origin, count(*) AS a, count(*) FILTER (dist = 1) AS d1, sum(r) AS mass
        FROM hits JOIN pr USING (id) GROUP BY 1),
sc AS (
SELECT a.id AS target, coalesce(agg.a, 0) AS affected_count,
  round_even(least(100.0, 40 * least(coalesce(d1, 0) / c, 1) + 20 * least(coalesce(agg.a, 0) / c, 1)
    + 20 * least(pr.r * 10, 1) + 20 * least(coalesce(mass, 0) * 5, 1)), 1) AS impact_score
FROM asked a JOIN pr ON pr.id = a.id JOIN nn ON nn.repo = a.repo LEFT JOIN agg ON agg.origin = a.id)
"""
RISK = ("CASE WHEN impact_score >= 70 THEN 'critical' WHEN impact_score >= 40 THEN 'high' "
        "WHEN impact_score >= 15 THEN 'medium' ELSE 'low' END AS risk_level")


@query("impact_score", SCORES + f"SELECT *, {RISK} FROM sc")
def impact_score(spark, sf):
    n, e = parts(spark, sf)
    return impact.impact_scores(n, e, None).drop("repo")


@query("risk_level", SCORES + f"SELECT risk_level, count(*) AS targets FROM (SELECT {RISK} FROM sc) GROUP BY 1")
def risk_level(spark, sf):
    n, e = parts(spark, sf)
    got = impact.impact_scores(n, e, None)
    return got.groupBy("risk_level").agg(F.count(F.lit(1)).alias("targets"))


@query("impact_report", SCORES + f""",
back(origin, id, dist) AS (
  SELECT id, id, 0 FROM asked
  UNION SELECT b.origin, e.target, b.dist + 1 FROM back b JOIN e ON e.source = b.id, lim WHERE b.dist < lim.c),
deps AS (SELECT origin AS target, count(DISTINCT id) AS depends_on FROM back WHERE origin <> id GROUP BY 1)
SELECT target, affected_count, impact_score, {RISK},
  coalesce(depends_on, 0) AS depends_on FROM sc LEFT JOIN deps USING (target)""")
def impact_report(spark, sf):
    n, e = parts(spark, sf)
    got = impact.impact_report(n, e, _asked(n), _rank(spark, sf))
    deps = got["backward"].groupBy("target").agg(F.count(F.lit(1)).alias("depends_on"))
    return got["summary"].drop("repo").join(deps, "target", "left").na.fill(0, ["depends_on"])


CHAINS = """, tgt AS (SELECT id FROM n),
away(origin, id, dist) AS (
  SELECT id, id, 0 FROM tgt
  UNION SELECT a.origin, e.source, a.dist + 1 FROM away a JOIN e ON e.target = a.id, lim WHERE a.dist < lim.c),
ad AS MATERIALIZED (SELECT origin, id, min(dist) AS dist FROM away GROUP BY 1, 2),
nxt AS MATERIALIZED (
  SELECT ad.origin, ad.id, min(e.target) AS nxt FROM ad JOIN e ON e.source = ad.id
  JOIN ad b ON b.origin = ad.origin AND b.id = e.target AND b.dist = ad.dist - 1 GROUP BY 1, 2),
chain(origin, start, here, path) AS (
  SELECT ad.origin, f.id, f.id, [f.id] FROM entry f JOIN ad ON ad.id = f.id AND ad.dist > 0
  UNION ALL
  SELECT c.origin, c.start, x.nxt, list_append(c.path, x.nxt) FROM chain c
  JOIN nxt x ON x.origin = c.origin AND x.id = c.here WHERE c.here <> c.origin)
SELECT origin AS target, rank, array_to_string(path, '>') AS chain FROM (
  SELECT origin, path, row_number() OVER (PARTITION BY origin ORDER BY start) AS rank
  FROM chain WHERE here = origin) WHERE rank <= 3"""


@query("dependency_chains", PARTS + "," + ENTRY + CHAINS)
def dependency_chains(spark, sf):
    n, e = parts(spark, sf)
    got = impact.dependency_chains(n, e, None)
    return got.select("target", "rank", F.array_join(F.transform(
        "chain", lambda x: x.cast("string")), ">").alias("chain"))


@query("simulate_removal", PARTS + """,
links AS (SELECT DISTINCT source, target FROM e),
indeg AS (SELECT target AS id, count(*) AS d, min(source) AS only FROM links GROUP BY 1),
alive(gone, id) AS (
  SELECT g.id, x.id FROM n g JOIN n x USING (repo) LEFT JOIN indeg i ON i.id = x.id
  WHERE x.id <> g.id AND (i.d IS NULL OR (i.d = 1 AND i.only = g.id))
  UNION SELECT a.gone, l.target FROM alive a JOIN links l ON l.source = a.id WHERE l.target <> a.gone)
SELECT target, 'broken_import' AS kind, source AS id FROM links
UNION ALL
SELECT g.id, 'orphaned_file', x.id FROM n g JOIN n x USING (repo)
WHERE x.id <> g.id AND NOT EXISTS (SELECT 1 FROM alive a WHERE a.gone = g.id AND a.id = x.id)""")
def simulate_removal(spark, sf):
    n, e = parts(spark, sf)
    return impact.simulate_removal(n, e, _asked(n)).drop("repo")


@query("match_target", PARTS + """,
args AS (SELECT DISTINCT CASE id % 3 WHEN 0 THEN file_path WHEN 1 THEN label ELSE '/abs/' || file_path END
         AS argument, repo FROM n),
nn2 AS (SELECT file_path AS id, repo FROM n),
m AS (SELECT repo, argument, id, least(length(id), length(argument)) AS o,
             abs(length(id) - length(argument)) AS f
      FROM args JOIN nn2 USING (repo) WHERE ends_with(id, argument) OR ends_with(argument, id))
SELECT argument, id FROM (
  SELECT argument, id, row_number() OVER (PARTITION BY repo, argument ORDER BY -o, f, id) AS rn FROM m)
WHERE rn = 1""")
def match_target(spark, sf):
    n, _ = parts(spark, sf)
    i = F.col("id")
    args = n.select("repo", F.when(i % 3 == 0, F.col("file_path")).when(
        i % 3 == 1, F.col("label")).otherwise(F.concat(F.lit("/abs/"), "file_path")).alias("argument"))
    pool = n.select("repo", F.col("file_path").alias("id"), "file_path")
    return impact.match_target(pool, args).drop("repo")
