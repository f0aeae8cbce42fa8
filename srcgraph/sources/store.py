"""Snapshot store: Parquet tables by analysis id and version, published by one log row.

``<root>/<table>/analysis_id=<id>/version=<v>/`` holds ``nodes, edges, metrics``; ``<root>/analyses`` is the
log: ``analysis_id, version, saved_at, fingerprint, deleted``.  A version counts from the moment its log row is
there, which is one file, written after all tables.  So a reader sees the tables of one version or of the
one before, never a mixture, and a save that fails half way changes nothing.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "analyses"
TABLES = ("nodes", "edges", "metrics")
LOG_SCHEMA = ("analysis_id STRING, version STRING, saved_at TIMESTAMP, fingerprint STRING, deleted BOOLEAN")


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/{LOG}")


def analyses(spark: SparkSession, root: str) -> DataFrame:
    """The published version of every snapshot: ``analysis_id, version, saved_at, fingerprint``."""
    row = F.struct("version", "saved_at", "fingerprint", "deleted")
    newest = read_log(spark, root).groupBy("analysis_id").agg(F.max_by(row, "version").alias("r"))
    return newest.where("NOT r.deleted").select("analysis_id", "r.version", "r.saved_at", "r.fingerprint")


def folder(root: str, table: str, analysis_id: str) -> str:
    return f"{root}/{table}/analysis_id={quote(analysis_id, safe='')}"


def stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of all published snapshots (partitions of other versions are pruned at run time)."""
    return spark.read.parquet(f"{root}/{table}").drop("analysis_id").join(
        analyses(spark, root).select("analysis_id", "version"), "version").drop("version")


def published(spark: SparkSession, root: str, analysis_id: str) -> str:
    """Published version of a snapshot; ``KeyError`` when there is none."""
    row = analyses(spark, root).where(F.col("analysis_id") == analysis_id).first()
    if row is None:
        raise KeyError(analysis_id)
    return row.version


def load_analysis(spark: SparkSession, root: str, analysis_id: str, table: str = "nodes") -> DataFrame:
    """One table of a snapshot; only the partition of its published version is read."""
    version = published(spark, root, analysis_id)
    return spark.read.parquet(f"{folder(root, table, analysis_id)}/version={version}").withColumn(
        "analysis_id", F.lit(analysis_id))


def edges_from_analysis(spark: SparkSession, root: str, analysis_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a stored snapshot, ready for the graph operators."""
    return (load_analysis(spark, root, analysis_id, "nodes"),
            load_analysis(spark, root, analysis_id, "edges"))


def recent_analyses(analyses: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """Newest n snapshots with node and edge counts."""
    newest = analyses.select("analysis_id", "saved_at").orderBy(
        F.col("saved_at").desc(), "analysis_id").limit(n)
    count = lambda df, name: df.join(
        newest.select("analysis_id"), "analysis_id", "left_semi").groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias(name))
    return newest.join(count(nodes, "nodes"), "analysis_id", "left").join(
        count(edges, "edges"), "analysis_id", "left").na.fill(0, ["nodes", "edges"])


def unchanged(fingerprints: DataFrame, analyses: DataFrame) -> DataFrame:
    """Repos whose fingerprint is already stored and need no new run."""
    return fingerprints.join(analyses.select("repo", "fingerprint").distinct(),
                             ["repo", "fingerprint"], "left_semi")
