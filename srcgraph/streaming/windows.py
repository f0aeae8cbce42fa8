"""Windowed rates, ratios and quantiles; the same code on batch and stream.

On a stream the caller's frame passes ``watermarked`` first; rows later than the
watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: window, step and histogram bounds of the monitored service
WINDOW = "5 minutes"
STEP = "30 seconds"
BUCKETS = [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]


def watermarked(df: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Set the watermark of a stream (no effect on a batch)."""
    return df.withWatermark("ts", delay)


def seconds(interval: str) -> int:
    """Length of an interval such as ``5 minutes`` in seconds."""
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def _window(window: str, step: str | None) -> Column:
    return F.window("ts", window, step) if step else F.window("ts", window)


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"),
                     F.col("window.end").alias("window_end"), *rest)


def rate(events: DataFrame, by: list[str], window: str = WINDOW, step: str | None = STEP) -> DataFrame:
    """Events per second and label set in sliding windows."""
    got = events.groupBy(_window(window, step).alias("window"), *by).agg(
        F.count(F.lit(1)).alias("events"))
    return _flat(got).withColumn("rate", F.col("events") / seconds(window))


def counter_rate(
    samples: DataFrame, by: list[str], window: str = WINDOW, step: str = STEP
) -> DataFrame:
    """Per-second increase of counters in sliding windows, resets counted from 0.

    Samples are first reduced per step slice (increase inside, first and last
    value, by one sort and one aggregation on the same keys), then the few slices
    of a window are chained; a busy series is thus spread over its slices and no
    slice is held as a list.  Batch form; see ``carried.counter_step`` for a stream.
    """
    def gain(a: Column, b: Column) -> Column:
        return F.when(b >= a, b - a).otherwise(b)

    order = F.struct("ts", "value")
    before = F.lag("value").over(Window.partitionBy("slice", *by).orderBy("ts", "value"))
    slices = (
        samples.select(F.window("ts", step)["start"].alias("slice"), "ts", *by, "value")
        .withColumn("gain", F.when(before.isNull(), 0.0).otherwise(gain(before, F.col("value"))))
        .groupBy("slice", *by)
        .agg(F.sum("gain").alias("inside"), F.min_by("value", order).alias("first"),
             F.max_by("value", order).alias("last"), F.count(F.lit(1)).cast("int").alias("n"))
        .withColumnRenamed("slice", "ts"))
    chained = slices.groupBy(F.window("ts", window, step).alias("window"), *by).agg(
        F.array_sort(F.collect_list(F.struct("ts", "inside", "first", "last", "n"))).alias("s"))
    total = F.aggregate(
        F.col("s"),
        F.struct(F.lit(None).cast("double").alias("at"), F.lit(0.0).alias("sum"),
                 F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            x["last"].alias("at"),
            (acc["sum"] + x["inside"] + F.when(acc["at"].isNull(), 0.0).otherwise(
                gain(acc["at"], x["first"]))).alias("sum"),
            (acc["n"] + x["n"]).alias("n")))
    return _flat(chained.select("window", *by, total.alias("t"))).where("t.n > 1").select(
        "window_start", "window_end", *by, F.col("t.sum").alias("increase"),
        (F.col("t.sum") / seconds(window)).alias("rate"))


def ratio(
    events: DataFrame, part: Column, whole: Column, name: str, by: list[str] | None = None,
    window: str = WINDOW, step: str | None = STEP,
) -> DataFrame:
    """Share of rows meeting ``part`` among those meeting ``whole``, per window."""
    got = events.groupBy(_window(window, step).alias("window"), *(by or [])).agg(
        F.sum(F.when(part, 1).otherwise(0)).alias("part"),
        F.sum(F.when(whole, 1).otherwise(0)).alias("whole"))
    return _flat(got.where("whole > 0")).withColumn(name, F.col("part") / F.col("whole"))


def error_ratio(events: DataFrame, by: list[str] | None = None, window: str = WINDOW,
                step: str | None = STEP) -> DataFrame:
    """Errors over all requests (``status`` column)."""
    return ratio(events, F.col("status") == "error", F.col("status").isNotNull(), "error_ratio",
                 by, window, step)


def hit_ratio(events: DataFrame, by: list[str] | None = None, window: str = WINDOW,
              step: str | None = STEP) -> DataFrame:
    """Cache hits over hits and misses (``outcome`` column)."""
    return ratio(events, F.col("outcome") == "hit", F.col("outcome").isin("hit", "miss"),
                 "hit_ratio", by, window, step)


def bucket_counts(value: Column, bounds: list[float] = BUCKETS) -> Column:
    """Cumulative bucket counts as one array, the last entry counting all."""
    sums = [F.sum(F.when(value <= b, 1).otherwise(0)) for b in bounds]
    return F.array(*sums, F.count(value))


def bucket_quantile(q: float, counts: Column, bounds: list[float] = BUCKETS) -> Column:
    """Quantile by linear interpolation inside the bucket that holds its rank.

    Above the last bound the last bound is the answer; null without samples.
    """
    total = F.element_at(counts, -1)
    rank = F.lit(q) * total
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low = 0.0 if i == 0 else bounds[i - 1]
        below = F.lit(0) if i == 0 else counts[i - 1]
        inside = counts[i] - below
        point = F.lit(low) + (bounds[i] - low) * F.when(
            inside > 0, (rank - below) / inside).otherwise(1.0)
        out = F.when(counts[i] >= rank, point).otherwise(out)
    return F.when(total > 0, out)


def histogram_quantile(
    samples: DataFrame, quantiles: list[float], by: list[str] | None = None, window: str = WINDOW,
    step: str | None = STEP, bounds: list[float] = BUCKETS,
) -> DataFrame:
    """Interpolated quantiles (``p50`` ...) of ``value`` per window."""
    got = samples.groupBy(_window(window, step).alias("window"), *(by or [])).agg(
        bucket_counts(F.col("value"), bounds).alias("counts"))
    rows = _flat(got)
    for q in quantiles:
        rows = rows.withColumn(f"p{round(q * 100)}", bucket_quantile(q, F.col("counts"), bounds))
    return rows


def threshold_alert(rows: DataFrame, column: str, op: str, limit: float) -> DataFrame:
    """Rows with a ``breach`` flag: the value compared with a limit."""
    ops = {">": F.col(column) > limit, "<": F.col(column) < limit,
           ">=": F.col(column) >= limit, "<=": F.col(column) <= limit, "==": F.col(column) == limit}
    return rows.withColumn("breach", F.coalesce(ops[op], F.lit(False)))


# fixed values: alert rules as (name, measure, operator, limit, for seconds, severity)
RULES = [
    ("HighErrorRate", "error_ratio", ">", 0.05, 300, "warning"),
    ("CriticalErrorRate", "error_ratio", ">", 0.20, 120, "critical"),
    ("SlowResponseTime", "p95", ">", 30.0, 600, "warning"),
    ("VerySlowResponseTime", "p95", ">", 60.0, 300, "critical"),
    ("LowCacheHitRatio", "hit_ratio", "<", 0.50, 900, "warning"),
    ("ServiceDown", "up", "==", 0.0, 60, "critical"),
    ("HighMemoryCacheUsage", "memory_cache_size", ">", 90.0, 600, "warning"),
    ("TooManyActiveAnalyses", "active_analyses", ">", 10.0, 300, "warning"),
]


def evaluate_rules(measures: DataFrame) -> DataFrame:
    """Evaluation rows of all rules: ``alert, severity, for_seconds, ts, labels, value, breach``.

    ``measures`` has ``ts, measure, labels STRING, value``.
    """
    rules = F.array(*[
        F.struct(F.lit(a).alias("alert"), F.lit(m).alias("measure"), F.lit(o).alias("op"),
                 F.lit(lim).alias("limit"), F.lit(f).alias("for_seconds"), F.lit(s).alias("severity"))
        for a, m, o, lim, f, s in RULES])
    mine = F.filter(rules, lambda r: r["measure"] == F.col("measure"))
    rows = measures.select("ts", "labels", "value", F.explode(mine).alias("r"))
    v, lim, op = F.col("value"), F.col("r.limit"), F.col("r.op")
    breach = F.when(op == ">", v > lim).when(op == "<", v < lim).otherwise(v == lim)
    return rows.select(F.col("r.alert").alias("alert"), F.col("r.severity").alias("severity"),
                       F.col("r.for_seconds").alias("for_seconds"), "ts", "labels", "value",
                       breach.alias("breach"))


def job_progress(events: DataFrame) -> DataFrame:
    """Latest state per analysis."""
    return events.groupBy("analysis_id").agg(
        F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "progress")).alias("s")
    ).select("analysis_id", F.col("s.status").alias("status"), F.col("s.progress").alias("progress"),
             F.col("s.ts").alias("ts"))


# fixed values: progress per stage and the number of retries
STAGES = {"validating": 0, "discovering": 10, "parsing": 30, "building_graph": 60, "analyzing": 80}
MAX_RETRIES = 3


def progress_fanout(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Updates per subscriber of their analysis: ``subscriber`` joined by analysis id."""
    return events.join(subscriptions.select("analysis_id", "subscriber"), "analysis_id")


def audit_summary(entries: DataFrame, window: str = "1 hour") -> DataFrame:
    """Counts by action, level and success per window."""
    rows = entries.withColumnRenamed("timestamp", "ts") if "timestamp" in entries.columns else entries
    got = rows.groupBy(F.window("ts", window).alias("window"), "action", "level", "success").agg(
        F.count(F.lit(1)).alias("entries"))
    return _flat(got)


def audit_by_user(entries: DataFrame, window: str = "1 hour") -> DataFrame:
    """Failed logins and denials per user and window."""
    rows = entries.withColumnRenamed("timestamp", "ts") if "timestamp" in entries.columns else entries
    got = rows.where(F.col("action").isin("login_failed", "access_denied")).groupBy(
        F.window("ts", window).alias("window"), "username").agg(
        F.sum((F.col("action") == "login_failed").cast("long")).alias("failed_logins"),
        F.sum((F.col("action") == "access_denied").cast("long")).alias("denials"))
    return _flat(got)
