"""Quality report and audit lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_rows(metrics: DataFrame, cycles: DataFrame, isolated: DataFrame,
                first: int | None = None) -> DataFrame:
    """The report of each repo as a nested row, with its cycles and isolated modules.

    ``first`` keeps that many entries of either list; the counts are always whole.
    """
    from srcgraph.operators.cycles import first_cycles
    from srcgraph.operators.metrics import top_by

    rings = cycles if first is None else first_cycles(cycles, first)
    rings = rings.groupBy("repo").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("length", "cycle"))), lambda x: x["cycle"])
        .alias("circular_dependencies"))
    alone = isolated if first is None else top_by(isolated.withColumn("one", F.lit(1)), "one", first)
    alone = alone.groupBy("repo").agg(
        F.array_sort(F.collect_list("id")).alias("isolated_modules"))
    return metrics.join(rings, "repo", "left").join(alone, "repo", "left").select(
        "repo", "total_files", "total_imports", "circular_dependencies",
        F.col("total_cycles").alias("circular_dependency_count"), "max_import_depth",
        "isolated_modules", F.col("isolated_count").alias("isolated_module_count"),
        F.struct("avg_imports_per_file", "max_imports_in_file", "max_imports_file",
                 "most_imported_module", "most_imported_count").alias("statistics"))


def report(rows: DataFrame) -> DataFrame:
    """``repo, report`` with the report as JSON text."""
    return rows.select("repo", F.to_json(F.struct(*[c for c in rows.columns if c != "repo"]),
                                         {"ignoreNullFields": "false"}).alias("report"))


def audit_row(action: str, level: str, **fields: Column) -> Column:
    """An audit struct with the given columns, the rest null."""
    from srcgraph.schemas import AUDIT

    fields = {"action": F.lit(action), "level": F.lit(level), **fields}
    return F.struct(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in AUDIT.fields])


def write_audit(entries: DataFrame, path: str) -> None:
    """Append audit entries as JSON lines."""
    entries.write.mode("append").json(path)


def stream_audit(entries: DataFrame, path: str, checkpoint: str):
    """The same as a streaming append."""
    return entries.writeStream.format("json").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append").start()
