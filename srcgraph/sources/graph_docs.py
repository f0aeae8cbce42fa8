"""Graph documents: JSON, GraphML and GEXF to node and edge tables.

The file name without its suffix, or else a ``repo=`` folder, names the repo, so a
folder of documents is read as a portfolio.  A document is read by one task.  Many small documents
may come as the rows of a table (``repo, text``) instead of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODE = "id STRING, file_path STRING, node_type STRING, external_kind STRING"
_EDGE = "source STRING, target STRING, import_type STRING, line_numbers ARRAY<INT>"


def _as_struct(fields: str) -> str:
    return "STRUCT<" + ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", ")) + ">"


_NODE_S = _as_struct(_NODE)
_EDGE_S = _as_struct(_EDGE)
_LISTS = (
    f"nodes: ARRAY<STRUCT<data: {_NODE_S}, " + _NODE_S[len("STRUCT<"):] + ">, "
    f"edges: ARRAY<STRUCT<data: {_EDGE_S}, " + _EDGE_S[len("STRUCT<"):] + ">")
_DOCUMENT = (
    f"elements STRUCT<{_LISTS}>, " + _LISTS.replace("nodes: ", "nodes ", 1).replace(
        ", edges: ", ", edges ", 1)
    + ", metadata STRUCT<project_path: STRING>, project_path STRING")


def _repo() -> Column:
    path = F.col("_metadata.file_path")
    folder = F.url_decode(F.regexp_extract(path, r"/repo=([^/]+)/", 1))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    return F.when(folder != "", folder).otherwise(name)


def default_attrs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill absent attributes, keep known external kinds only, add missing end nodes.

    Of duplicate nodes and edges one record counts: the one with the most attributes, then the
    greatest in the order of its columns.
    """
    def one(*names: str) -> Column:
        row = F.struct(*names)
        known = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
        return F.max_by(row, F.struct(known, row))

    edges = edges.where(
        "source IS NOT NULL AND source <> '' AND target IS NOT NULL AND target <> ''"
    ).groupBy("repo", "source", "target").agg(one("import_type", "line_numbers").alias("x")).select(
        "repo", "source", "target", F.coalesce("x.import_type", F.lit("module")).alias("import_type"),
        F.coalesce("x.line_numbers", F.array().cast("array<int>")).alias("line_numbers"))
    named = nodes.groupBy("repo", "id").agg(one("node_type", "file_path", "external_kind").alias("x")).select(
        "repo", "id", F.coalesce("x.node_type", F.lit("module")).alias("node_type"),
        F.coalesce("x.file_path", F.col("id")).alias("file_path"),
        F.when(F.col("x.external_kind").isin("stdlib", "package"), F.col("x.external_kind"))
        .alias("external_kind"))
    ends = edges.select("repo", F.explode(F.array("source", "target")).alias("id")).distinct()
    extra = ends.join(named, ["repo", "id"], "left_anti").select(
        "repo", "id", F.lit("module").alias("node_type"), F.col("id").alias("file_path"),
        F.lit(None).cast("string").alias("external_kind"))
    return named.unionByName(extra), edges


def read_graph_json(spark: SparkSession, path: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wrapped (``elements``) or flat (``nodes``/``edges``) documents."""
    if isinstance(path, DataFrame):
        docs = path.select("repo", F.from_json("text", _DOCUMENT).alias("d")).select("repo", "d.*")
    else:
        docs = spark.read.schema(_DOCUMENT).option("multiLine", True).json(path).withColumn(
            "repo", _repo())
    n = docs.select("repo", F.explode(F.coalesce("elements.nodes", "nodes")).alias("n"))
    pick = lambda side, f: F.coalesce(F.col(f"{side}.data.{f}"), F.col(f"{side}.{f}"))
    name = F.coalesce(pick("n", "id"), F.nullif(pick("n", "file_path"), F.lit("")), F.lit("unknown"))
    nodes = n.select("repo", name.alias("id"), *[
        pick("n", f).alias(f) for f in ("file_path", "node_type", "external_kind")])
    e = docs.select("repo", F.explode(F.coalesce("elements.edges", "edges")).alias("e"))
    edges = e.select("repo", *[
        pick("e", f).alias(f) for f in ("source", "target", "import_type", "line_numbers")])
    return default_attrs(nodes, edges)


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The splittable form: ``nodes`` and ``edges`` folders of JSON lines."""
    nodes = spark.read.schema("repo STRING, " + _NODE).json(f"{path}/nodes")
    edges = spark.read.schema("repo STRING, " + _EDGE).json(f"{path}/edges")
    return default_attrs(nodes, edges)


def _xml(spark: SparkSession, path: str | DataFrame, tag: str, schema: str, *around: str) -> DataFrame:
    """All elements ``tag``; in rows of documents they stand inside the elements ``around``, below the root."""
    if isinstance(path, DataFrame):
        shape = T.StructType.fromDDL(schema)
        for name in (tag, *reversed(around)):
            shape = T.StructType([T.StructField(name, T.ArrayType(shape))])
        found = path.select("repo", F.from_xml("text", shape).alias("x"))
        for name in (*around, tag):
            found = found.select("repo", F.explode(F.col("x").getField(name)).alias("x"))
        return found.select("x.*", "repo")
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn(
        "repo", _repo())


def _undirected(spark: SparkSession, path: str | DataFrame, attribute: str) -> DataFrame:
    """Documents whose edges count in both directions."""
    rx = attribute + r"""\s*=\s*["']undirected["']"""
    if isinstance(path, DataFrame):
        return path.where(F.col("text").rlike(rx)).select("repo").distinct()
    return spark.read.text(path).where(F.col("value").rlike(rx)).select(
        _repo().alias("repo")).distinct()


def _both_ways(edges: DataFrame, undirected: DataFrame) -> DataFrame:
    turned = edges.join(undirected, "repo", "left_semi").select(
        "repo", F.col("target").alias("source"), F.col("source").alias("target"),
        *[c for c in edges.columns if c not in ("repo", "source", "target")])
    return edges.unionByName(turned)


def _lines(column: str) -> Column:
    return F.when(F.col(column).isNotNull() & (F.col(column) != ""), F.transform(
        F.split(column, ","), lambda x: F.trim(x).cast("int")))


def _wide(rows: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Attribute rows (key, name, value) to one row per key."""
    return rows.groupBy(*key).agg(*[
        F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def read_graphml(spark: SparkSession, path: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = _xml(spark, path, "key", "`_id` STRING, `_for` STRING, `_attr.name` STRING").select(
        "repo", F.col("_for").alias("domain"), F.col("_id").alias("key"),
        F.col("`_attr.name`").alias("name")).distinct()  # every document of a repo declares them
    data = "data ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>"

    def attrs(df: DataFrame, domain: str, key: list[str], names: list[str]) -> DataFrame:
        rows = df.select("repo", *key, F.explode_outer("data").alias("d")).select(
            "repo", *key, F.col("d._key").alias("key"), F.col("d._VALUE").alias("value"))
        mine = keys.where(F.col("domain").isin(domain, "all")).select("repo", "key", "name")
        return _wide(rows.join(mine, ["repo", "key"], "left"), ["repo", *key], names)

    n = _xml(spark, path, "node", f"`_id` STRING, {data}", "graph").withColumnRenamed("_id", "id")
    e = _xml(spark, path, "edge", f"`_source` STRING, `_target` STRING, {data}", "graph").select(
        "repo", F.col("_source").alias("source"), F.col("_target").alias("target"), "data")
    nodes = attrs(n, "node", ["id"], ["file_path", "node_type", "external_kind"])
    edges = attrs(e, "edge", ["source", "target"], ["import_type", "line_numbers"]).withColumn(
        "line_numbers", _lines("line_numbers"))
    return default_attrs(nodes, _both_ways(edges, _undirected(spark, path, "edgedefault")))


def read_gexf(spark: SparkSession, path: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    titles = _xml(spark, path, "attributes",
                  "`_class` STRING, attribute ARRAY<STRUCT<_id: STRING, _title: STRING>>", "graph").select(
        "repo", F.col("_class").alias("domain"), F.explode("attribute").alias("a")).select(
        "repo", "domain", F.col("a._id").alias("key"), F.col("a._title").alias("name")).distinct()  # every document of a repo declares them
    data = "attvalues STRUCT<attvalue: ARRAY<STRUCT<_for: STRING, _value: STRING>>>"

    def attrs(df: DataFrame, domain: str, key: list[str], names: list[str]) -> DataFrame:
        rows = df.select("repo", *key, F.explode_outer("attvalues.attvalue").alias("d")).select(
            "repo", *key, F.col("d._for").alias("key"), F.col("d._value").alias("value"))
        mine = titles.where(F.col("domain") == domain).select("repo", "key", "name")
        return _wide(rows.join(mine, ["repo", "key"], "left"), ["repo", *key], names)

    n = _xml(spark, path, "node", f"`_id` STRING, {data}", "graph", "nodes").withColumnRenamed("_id", "id")
    e = _xml(spark, path, "edge", f"`_source` STRING, `_target` STRING, {data}", "graph", "edges").select(
        "repo", F.col("_source").alias("source"), F.col("_target").alias("target"), "attvalues")
    nodes = attrs(n, "node", ["id"], ["file_path", "node_type", "external_kind"])
    edges = attrs(e, "edge", ["source", "target"], ["import_type", "line_numbers"]).withColumn(
        "line_numbers", _lines("line_numbers"))
    return default_attrs(nodes, _both_ways(edges, _undirected(spark, path, "defaultedgetype")))
