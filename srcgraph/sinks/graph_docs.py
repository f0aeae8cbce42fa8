"""Graph export: JSON, GraphML and GEXF documents as ordered text lines.

A graph is one document per repo.  With ``limit`` it becomes several documents of that
many rows on average, each well formed, with its nodes and edges spread over them by
hash; readers take all documents of a repo together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape_xml(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _joined_lines(edges: DataFrame) -> Column:
    if "line_numbers" not in edges.columns:
        return F.lit("")
    return F.array_join(F.transform("line_numbers", lambda x: x.cast("string")), ",")


def _document(nodes: DataFrame, edges: DataFrame, node_line: Column, edge_line: Column,
              head: list[str], middle: list[str], tail: list[str], limit: int | None) -> DataFrame:
    """Lines with their place: ``repo, part, section, key, value``."""
    n = nodes.select("repo", F.lit(1).alias("section"), F.col("id").cast("string").alias("key"),
                     node_line.alias("value"))
    e = edges.select("repo", F.lit(3).alias("section"), F.concat_ws(
        "\x00", F.col("source").cast("string"), F.col("target").cast("string")).alias("key"),
        edge_line.alias("value"))
    sizes = nodes.select("repo").unionByName(edges.select("repo")).groupBy("repo").agg(
        (F.lit(1) if limit is None else F.ceil(F.count(F.lit(1)) / limit)).cast("int").alias("parts"))
    body = n.unionByName(e).join(sizes, "repo").select(
        "repo", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "section", "key",
        "value")
    fixed = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(f"{i:04d}").alias("key"), F.lit(v).alias("value"))
        for s, lines in ((0, head), (2, middle), (4, tail)) for i, v in enumerate(lines)])
    frame = sizes.select("repo", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
                         ).select("repo", "part", F.inline(fixed))
    return body.unionByName(frame)


def graphml_lines(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    def data(key: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f'<data key="{key}">'), escape_xml(value),
                                   F.lit("</data>")), F.lit(""))

    node = F.concat(
        F.lit('<node id="'), escape_xml(F.col("id").cast("string")), F.lit('">'),
        data("d0", _text(nodes, "file_path")), data("d1", _text(nodes, "node_type")),
        data("d2", _text(nodes, "external_kind")), F.lit("</node>"))
    edge = F.concat(
        F.lit('<edge source="'), escape_xml(F.col("source").cast("string")),
        F.lit('" target="'), escape_xml(F.col("target").cast("string")), F.lit('">'),
        data("d3", _text(edges, "import_type")), data("d4", _joined_lines(edges)),
        F.lit("</edge>"))
    head = [
        "<?xml version='1.0' encoding='utf-8'?>",
        '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
        '<key id="d0" for="node" attr.name="file_path" attr.type="string" />',
        '<key id="d1" for="node" attr.name="node_type" attr.type="string" />',
        '<key id="d2" for="node" attr.name="external_kind" attr.type="string" />',
        '<key id="d3" for="edge" attr.name="import_type" attr.type="string" />',
        '<key id="d4" for="edge" attr.name="line_numbers" attr.type="string" />',
        '<graph edgedefault="directed">',
    ]
    return _document(nodes, edges, node, edge, head, [], ["</graph>", "</graphml>"], limit)


def gexf_lines(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    def att(key: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f'<attvalue for="{key}" value="'), escape_xml(value),
                                   F.lit('" />')), F.lit(""))

    name = escape_xml(F.col("id").cast("string"))
    node = F.concat(
        F.lit('<node id="'), name, F.lit('" label="'), name, F.lit('"><attvalues>'),
        att("0", _text(nodes, "file_path")), att("1", _text(nodes, "node_type")),
        att("2", _text(nodes, "external_kind")), F.lit("</attvalues></node>"))
    edge = F.concat(
        F.lit('<edge source="'), escape_xml(F.col("source").cast("string")), F.lit('" target="'),
        escape_xml(F.col("target").cast("string")), F.lit('"><attvalues>'),
        att("3", _text(edges, "import_type")), att("4", _joined_lines(edges)),
        F.lit("</attvalues></edge>"))
    head = [
        "<?xml version='1.0' encoding='utf-8'?>",
        '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">',
        '<graph defaultedgetype="directed" mode="static">',
        '<attributes class="node" mode="static">',
        '<attribute id="0" title="file_path" type="string" />',
        '<attribute id="1" title="node_type" type="string" />',
        '<attribute id="2" title="external_kind" type="string" />', "</attributes>",
        '<attributes class="edge" mode="static">',
        '<attribute id="3" title="import_type" type="string" />',
        '<attribute id="4" title="line_numbers" type="string" />', "</attributes>", "<nodes>",
    ]
    return _document(nodes, edges, node, edge, head, ["</nodes>", "<edges>"],
                     ["</edges>", "</graph>", "</gexf>"], limit)


def json_lines(nodes: DataFrame, edges: DataFrame, metadata: DataFrame | None = None,
               limit: int | None = None) -> DataFrame:
    """The JSON document; ``metadata`` has ``repo, project_path, total_files, total_imports``."""
    opts = {"ignoreNullFields": "false"}

    # the comma leads, so no row needs to know whether it is the last one
    def row(df: DataFrame) -> Column:
        return F.concat(F.lit(',{"data":'), F.to_json(F.struct(*[
            c for c in df.columns if c != "repo"]), opts), F.lit("}"))

    doc = _document(nodes, edges, row(nodes), row(edges), ['{"elements":{"nodes":['], ['],"edges":['],
                    [']},"metadata":'], limit)
    place = ["repo", "part", "section"]
    first = doc.where("section IN (1, 3)").groupBy(*place).agg(F.min("key").alias("first"))
    if metadata is None:
        meta = nodes.select("repo").distinct().withColumn("meta", F.lit("{}"))
    else:
        meta = metadata.select("repo", F.to_json(F.struct(
            "project_path", "total_files", "total_imports"), opts).alias("meta"))
    value = (
        F.when(F.col("section") == 4, F.concat("value", F.coalesce("meta", F.lit("{}")), F.lit("}")))
        .when(F.col("key") == F.col("first"), F.expr("substring(value, 2)"))
        .otherwise(F.col("value")))
    return doc.join(first, place, "left").join(meta, "repo", "left").select(
        *place, "key", value.alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One sorted text file per document: ``repo=<repo>/part=<n>/``."""
    lines.repartition("repo", "part").sortWithinPartitions("repo", "part", "section", "key").select(
        "repo", "part", "value").write.mode("overwrite").partitionBy("repo", "part").text(path)


def documents(lines: DataFrame) -> DataFrame:
    """Whole documents as rows, for many small ones that would each be a file: ``repo, part, text``."""
    return lines.groupBy("repo", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("section", "key", "value"))), lambda x: x["value"]), "\n").alias("text"))


def write_graph_lines(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The splittable form: folders of JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
