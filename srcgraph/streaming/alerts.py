"""Alert state over time, batch form.

A series may hold a large part of all rows, so no ordered window spans a whole
series: rows are ordered inside (series, chunk) and one summary row per chunk
carries the state across chunk borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _chunk(chunk: str):
    return F.window("ts", chunk)["start"]


def _micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


def previous(rows: DataFrame, by: list[str], columns: list[str], ties: list = (), chunk: str = "1 day") -> DataFrame:
    """Add ``p_<column>``, the value on the row before in order of ``ts, *ties``; null on the first.

    Ordered inside (series, chunk); one summary row per chunk reaches over its border.
    """
    rows = rows.withColumn("chunk", _chunk(chunk))
    inside = Window.partitionBy(*by, "chunk").orderBy("ts", *ties)
    border = Window.partitionBy(*by).orderBy("chunk")
    rows = rows.withColumn("__next", F.lead(F.lit(1)).over(inside))
    for c in columns:
        rows = rows.withColumn(f"p_{c}", F.lag(c).over(inside))
    rows = rows.withColumn("__first", F.lag(F.lit(1)).over(inside).isNull())
    tails = rows.where("__next IS NULL").select(
        *by, "chunk", *[F.lag(c).over(border).alias(f"c_{c}") for c in columns])
    rows = rows.join(tails, [*by, "chunk"])
    for c in columns:
        rows = rows.withColumn(f"p_{c}", F.when(F.col("__first"), F.col(f"c_{c}")).otherwise(F.col(f"p_{c}")))
    return rows.drop("chunk", "__next", "__first", *[f"c_{c}" for c in columns])


def alert_for(evals: DataFrame, by: list[str], for_seconds, step_seconds: int = 30,
              chunk: str = "1 day", begun: str | None = None) -> DataFrame:
    """Add ``since`` and ``state`` (inactive, pending, firing, resolved) to evaluations.

    ``evals`` has ``ts, breach`` on a grid of ``step_seconds`` per series.  An alert
    fires once the breach held for ``for_seconds`` (a number or a column name)
    without a gap; a missing evaluation resets it.  Resolved marks the first calm
    evaluation after a firing one.  ``begun`` names a column with the start of a breach that
    began before the series' first evaluation here.
    """
    need = (F.col(for_seconds) if isinstance(for_seconds, str) else F.lit(for_seconds)).cast("long")
    carry = [for_seconds] if isinstance(for_seconds, str) else []
    rows = evals.withColumn("chunk", _chunk(chunk))
    inside = Window.partitionBy(*by, "chunk").orderBy("ts")
    past = inside.rowsBetween(Window.unboundedPreceding, 0)
    border = Window.partitionBy(*by).orderBy("chunk")
    gap = F.make_dt_interval(secs=F.lit(step_seconds).cast("decimal(18,6)"))
    rows = rows.withColumn("p_ts", F.lag("ts").over(inside)).withColumn(
        "p_breach", F.lag("breach").over(inside))
    tail = rows.groupBy(*by, "chunk").agg(
        F.max("ts").alias("last_ts"), F.max_by("breach", "ts").alias("last_breach"))
    tail = tail.select(*by, "chunk", F.lag("last_ts").over(border).alias("c_ts"),
                       F.lag("last_breach").over(border).alias("c_breach"))
    rows = rows.join(tail, [*by, "chunk"]).withColumn("p_ts", F.coalesce("p_ts", "c_ts")).withColumn(
        "p_breach", F.coalesce("p_breach", "c_breach")).drop("c_ts", "c_breach")
    linked = F.coalesce((F.col("p_ts") + gap >= F.col("ts")) & F.col("p_breach"), F.lit(False))
    first = F.col("ts") if begun is None else F.coalesce(begun, "ts")
    rows = rows.withColumn("start", F.when(F.col("breach") & ~linked, first))
    rows = rows.withColumn("own", F.max("start").over(past))
    ends = rows.groupBy(*by, "chunk").agg(F.max("start").alias("last_start"))
    ends = ends.select(*by, "chunk", F.max("last_start").over(
        border.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    rows = rows.join(ends, [*by, "chunk"])
    since = F.coalesce("own", "carried")
    held = lambda t: _micros(t) - _micros(since) >= need * 1000000
    state = (
        F.when(F.col("breach") & held(F.col("ts")), "firing").when(F.col("breach"), "pending")
        .when(linked & held(F.col("p_ts")), "resolved").otherwise("inactive"))
    return rows.select(*by, "ts", "breach", *carry,
                       F.when(F.col("breach"), since).alias("since"), state.alias("state"))


def up_check(samples: DataFrame, by: list[str], max_gap_seconds: int = 60,
             chunk: str = "1 day", until=None) -> DataFrame:
    """Times a target was down: ``down_from, down_until`` of gaps above the limit.

    ``until`` closes the last gap of every series (default: none is reported).
    """
    rows = samples.select(*by, "ts").distinct().withColumn("chunk", _chunk(chunk))
    inside = Window.partitionBy(*by, "chunk").orderBy("ts")
    border = Window.partitionBy(*by).orderBy("chunk")
    rows = rows.withColumn("next_ts", F.lead("ts").over(inside))
    head = rows.groupBy(*by, "chunk").agg(F.min("ts").alias("first"))
    head = head.select(*by, "chunk", F.lead("first").over(border).alias("after"))
    rows = rows.join(head, [*by, "chunk"])
    close = F.coalesce("next_ts", "after") if until is None else F.coalesce(
        "next_ts", "after", F.lit(until).cast("timestamp"))
    late = _micros(F.col("down_until")) - _micros(F.col("last_seen"))
    return rows.select(*by, F.col("ts").alias("last_seen"), close.alias("down_until")).where(
        late > max_gap_seconds * 1000000).select(
        *by, "last_seen",
        (F.col("last_seen") + F.make_dt_interval(
            secs=F.lit(max_gap_seconds).cast("decimal(18,6)"))).alias("down_from"), "down_until")
