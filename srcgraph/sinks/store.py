"""Snapshot store writes: publish, delete, expiry, clearing and statistics."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.sources.store import LOG, LOG_SCHEMA, TABLES, analyses, folder, published
from srcgraph.stage import drop_path, path_exists


def new_version(hours_ago: float = 0) -> str:
    """Later versions have greater names."""
    return f"v{time.time_ns() - int(hours_ago * 3.6e12):020d}-{uuid.uuid4().hex[:8]}"


def publish(root: str, rows: DataFrame) -> None:
    """Append ``analysis_id, version, saved_at, fingerprint, deleted`` to the log."""
    columns = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    rows.select(*columns).write.mode("append").parquet(f"{root}/{LOG}")


def save_analysis(root: str, analysis_id: str, tables: dict[str, DataFrame],
                  fingerprint: str | None = None) -> str:
    """Replace the snapshot of an id; other snapshots stay.  Returns the version.

    All tables are written to a version of their own; the log row that publishes it comes last.  The
    replaced version stays for readers that have begun, until ``vacuum``.
    """
    unknown = [name for name in tables if name not in TABLES]
    if unknown:
        raise ValueError(f"unknown snapshot table {unknown[0]}")
    spark = next(iter(tables.values())).sparkSession
    version = new_version()
    for name, df in tables.items():
        df.drop("analysis_id", "version").write.parquet(
            f"{folder(root, name, analysis_id)}/version={version}")
    publish(root, spark.range(0, 1, 1, 1).select(
        F.lit(analysis_id).alias("analysis_id"), F.lit(version).alias("version"),
        F.current_timestamp().alias("saved_at"), F.lit(fingerprint).cast("string").alias("fingerprint"),
        F.lit(False).alias("deleted")))
    return version


def _withdraw(spark: SparkSession, root: str, ids: DataFrame) -> None:
    """Log rows that end the snapshots of ``ids``: one job for any number of them."""
    publish(root, ids.select("analysis_id").distinct().select(
        "analysis_id", F.lit(new_version()).alias("version"), F.current_timestamp().alias("saved_at"),
        F.lit(None).cast("string").alias("fingerprint"), F.lit(True).alias("deleted")))


def delete_analysis(spark: SparkSession, root: str, analysis_id: str) -> None:
    """Drop a snapshot; ``KeyError`` when there is none."""
    published(spark, root, analysis_id)
    _withdraw(spark, root, spark.range(0, 1, 1, 1).select(F.lit(analysis_id).alias("analysis_id")))
    for name in TABLES:
        drop_path(spark, folder(root, name, analysis_id))


def expired(analyses: DataFrame, days: int, now: str | None = None) -> DataFrame:
    """Ids of snapshots older than the given days (counted from ``now``, default the present)."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    limit = at - F.make_dt_interval(F.lit(days))
    return analyses.where(F.col("saved_at") < limit).select("analysis_id")


def expire_analyses(spark: SparkSession, root: str, days: int = 7, now: str | None = None) -> int:
    """End all snapshots older than the given days in one job; the number ended.  ``vacuum`` frees their space."""
    before = analyses(spark, root).count()
    _withdraw(spark, root, expired(analyses(spark, root), days, now))
    return before - analyses(spark, root).count()


def vacuum(spark: SparkSession, root: str, hours: float = 24) -> int:
    """Delete folders of versions that were replaced, ended or never published; the number deleted.

    Versions of the last ``hours`` stay: their save may be running, or a reader may have begun before they were
    replaced.  Only folder names pass the driver, one at a time.
    """
    keep, gone = analyses(spark, root).select("version"), 0
    for name in TABLES:
        if not path_exists(spark, f"{root}/{name}"):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/{name}").select(
            F.regexp_extract("path", "/analysis_id=([^/]*)/version=", 1).alias("name"),
            F.regexp_extract("path", "/version=([^/]*)/", 1).alias("version"))
        old = files.where(F.col("version") < new_version(hours)).distinct().join(keep, "version", "left_anti")
        for row in old.toLocalIterator():
            gone += drop_path(spark, f"{root}/{name}/analysis_id={row.name}/version={row.version}")
    return gone


def store_stats(spark: SparkSession, root: str) -> DataFrame:
    """``entry_count, size_mb`` of a store; of the files only lengths are read."""
    entries = analyses(spark, root).select("analysis_id", F.lit(0).cast("long").alias("length"))
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select(F.lit(None).cast("string").alias("analysis_id"), "length"))
    return entries.unionByName(files).agg(
        F.countDistinct("analysis_id").alias("entry_count"),
        F.bround(F.coalesce(F.sum("length"), F.lit(0)) / (1024 * 1024), 2).alias("size_mb"))
