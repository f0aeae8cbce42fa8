"""Health score, issues, recommendations and quality gates on a metrics table.

The metrics table has one row per repo with ``total_cycles, max_import_depth,
isolated_count, total_files`` and, for the hub rule, ``hub_modules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def _deep() -> Column:
    return F.greatest(F.col("max_import_depth") - 10, F.lit(0)) * 2


def health_score() -> Column:
    """100, less 5 per cycle (at most 30) and 2 per level beyond 10."""
    return _clamp(100 - F.least(F.col("total_cycles") * 5, F.lit(30)) - _deep()).cast("long")


def gate_score() -> Column:
    """Report variant: the cycle penalty has no limit."""
    return _clamp(100 - F.col("total_cycles") * 5 - _deep()).cast("long")


def health_status(score: Column) -> Column:
    return (F.when(score >= 90, "excellent").when(score >= 70, "good")
            .when(score >= 50, "fair").otherwise("poor"))


def health(metrics: DataFrame) -> DataFrame:
    return metrics.select("repo", health_score().alias("health_score")).withColumn(
        "health_status", health_status(F.col("health_score")))


def issues(metrics: DataFrame) -> DataFrame:
    """Issue rows: ``repo, type, severity, count, message``."""
    def row(kind: str, severity: Column, count: Column, text: list) -> Column:
        return F.struct(F.lit(kind).alias("type"), severity.alias("severity"),
                        count.cast("long").alias("count"), F.concat(*text).alias("message"))

    c, d, i = F.col("total_cycles"), F.col("max_import_depth"), F.col("isolated_count")
    found = F.array_compact(F.array(
        F.when(c > 0, row("circular_dependencies", F.when(c > 5, "high").otherwise("medium"), c,
                          [F.lit("Found "), c.cast("string"), F.lit(" circular dependencies")])),
        F.when(d > 10, row("deep_imports", F.lit("medium"), d,
                           [F.lit("Maximum import depth is "), d.cast("string")])),
        F.when(i > 0, row("isolated_modules", F.lit("low"), i,
                          [F.lit("Found "), i.cast("string"), F.lit(" isolated modules")]))))
    return metrics.select("repo", F.explode(found).alias("x")).select("repo", "x.*")


def recommendations(metrics: DataFrame) -> DataFrame:
    """Recommendation rows: ``repo, category, priority, title, description``."""
    # fixed values: titles and sentences of the recommendations
    def row(category: str, priority: str, title: str, description: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(priority).alias("priority"),
                        F.lit(title).alias("title"), description.alias("description"))

    names = F.array_join(F.transform(F.slice("hub_modules", 1, 5), lambda m: m["module"]), ", ")
    found = F.array_compact(F.array(
        F.when(F.col("total_cycles") > 0, row(
            "architecture", "high", "Break circular dependencies",
            F.lit("Circular dependencies make code harder to test and maintain. "
                  "Consider refactoring to break these cycles."))),
        F.when(F.col("max_import_depth") > 10, row(
            "architecture", "medium", "Reduce import depth",
            F.lit("Deep import chains can indicate overly complex dependencies. "
                  "Consider flattening your module structure."))),
        F.when(F.size("hub_modules") > 0, row(
            "testing", "high", "Focus testing on hub modules",
            F.concat(F.lit("The top 5 most important modules are: "), names,
                     F.lit(". These should have comprehensive tests."))))))
    return metrics.select("repo", F.explode(found).alias("x")).select("repo", "x.*")


def insights(metrics: DataFrame, title: int | None = None) -> DataFrame:
    """Issues as insight items next to score, status and summary counts.

    ``title`` cuts the titles to so many characters.
    """
    items = issues(metrics).select(
        "repo", F.when(F.col("severity").isin("high", "medium"), "warning").otherwise("info")
        .alias("type"), (F.col("message") if title is None else F.substring("message", 1, title)).alias("title"),
        F.col("message").alias("description"), "severity")
    head = metrics.select("repo", health_score().alias("health_score"), "total_files",
                          F.col("total_cycles").alias("circular_dependencies"),
                          F.col("isolated_count").alias("isolated_modules"),
                          F.col("max_import_depth").alias("max_depth"))
    return head.withColumn("health_status", health_status(F.col("health_score"))).join(
        items, "repo", "left")


def quality_gate(
    metrics: DataFrame, max_cycles: int | None = None, max_depth: int | None = None
) -> DataFrame:
    """``cycles_ok, depth_ok, passed`` against the given limits (unset ones pass)."""
    ok = lambda c, lim: F.lit(True) if lim is None else F.col(c) <= lim
    return metrics.select(
        "repo", ok("total_cycles", max_cycles).alias("cycles_ok"),
        ok("max_import_depth", max_depth).alias("depth_ok"),
    ).withColumn("passed", F.col("cycles_ok") & F.col("depth_ok"))
