"""Staged tables: how loops cut their lineage.

A loop round is written as a Parquet table under the shared checkpoint folder
and read back.  The table survives the loss of executors, and its file size is
known to the optimizer, so the next round's join strategy (broadcast or
shuffle) follows the measured size and not a guess.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables, as named by ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-srcgraph-", dir="/tmp")
    return _local_dirs[app]


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder; False when it does not exist."""
    fs, hpath = _filesystem(spark, path)
    return bool(fs.delete(hpath, True)) if fs.exists(hpath) else False


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _filesystem(spark, path)
    return bool(fs.exists(hpath))


class Stage:
    """Writes staged tables for one operator run and remembers their paths."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/srcgraph/{name}-{uuid.uuid4().hex}"
        self._count = 0

    def write(self, df: DataFrame, **metrics: Column) -> tuple[str, dict]:
        """Write ``df`` in one job; ``metrics`` are observed by that same job."""
        path = f"{self.root}/{self._count:05d}"
        self._count += 1
        observation = None
        if metrics:
            observation = Observation()
            df = df.observe(observation, *[c.alias(n) for n, c in metrics.items()])
        df.write.mode("overwrite").parquet(path)
        return path, (observation.get if observation else {})

    def read(self, schema, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def compact(self, schema, paths: list[str]) -> list[str]:
        """The same rows in one table once there are many small ones.

        Keeps listing cheap (Spark lists more than 32 paths by a job of its own).
        """
        if len(paths) < 24:
            return paths
        merged, _ = self.write(self.read(schema, *paths))
        return [merged]

    def save(self, df: DataFrame, schema=None, **metrics: Column) -> tuple[DataFrame, dict]:
        """Write and read back (the columns of ``schema``, default all)."""
        path, got = self.write(df, **metrics)
        out = self.read(schema or df.schema, path)
        out._stage_path = path
        return out, got

    def drop(self, df: DataFrame | None) -> None:
        """Delete the table behind a DataFrame returned by ``save``."""
        path = getattr(df, "_stage_path", None)
        if path:
            drop_path(self.spark, path)


_shared: dict[tuple, tuple] = {}


def _version(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of what lies in a folder."""
    fs, hpath = _filesystem(spark, folder)
    if not fs.exists(hpath):
        return ""
    return ";".join(sorted(
        f"{s.getPath().getName()},{s.getLen()},{s.getModificationTime()}" for s in fs.listStatus(hpath)))


def staged_once(spark: SparkSession, name: str, key: str, build) -> DataFrame:
    """A table derived from the folder ``key`` that several queries use, written on first use in a
    session and again when the folder's files change."""
    slot = (spark.sparkContext.applicationId, name, key, _version(spark, key))
    if slot not in _shared or not path_exists(spark, _shared[slot][0]):
        df = build()
        path, _ = Stage(spark, name).write(df)
        _shared[slot] = (path, df.schema)
    path, schema = _shared[slot]
    return spark.read.schema(schema).parquet(path)
