"""Audit lines, metric samples and progress events, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcgraph.schemas import AUDIT, PROGRESS, SAMPLES


def _scan(spark: SparkSession, path: str, schema, stream: bool) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def scan_audit(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return _scan(spark, path, AUDIT, stream)


def scan_metric_samples(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return _scan(spark, path, SAMPLES, stream)


def scan_progress(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return _scan(spark, path, PROGRESS, stream)
