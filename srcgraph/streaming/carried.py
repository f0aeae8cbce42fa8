"""Streams whose state is a table with one row a series.

A micro-batch is reduced by the batch operators (rows are ordered inside (series, chunk), one summary
row per chunk crosses the borders), so a series that holds most of a batch is spread over tasks.  What
a series carries on is one row of a Parquet table.  Batch ``n`` reads the state of batch ``n - 1`` and
overwrites its own folders: a batch that runs again after a failure gives the same rows.

Samples older than the carried one of their series are late and left out by ``counter_step``,
``alert_step`` and ``liveness_step``; ``progress_step`` takes updates in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.stage import Stage, drop_path
from srcgraph.streaming.alerts import alert_for, previous, up_check
from srcgraph.streaming.windows import job_progress

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]

COUNTER = "series STRING, ts TIMESTAMP, value DOUBLE"
ALERT = "series STRING, ts TIMESTAMP, breach BOOLEAN, since TIMESTAMP, state STRING"
LIVENESS = "series STRING, ts TIMESTAMP"
PROGRESS = "analysis_id STRING, status STRING, progress INT, ts TIMESTAMP"


def drain_carried(stream: DataFrame, name: str, step: Step, state: str,
                  rows: str) -> tuple[DataFrame, DataFrame]:
    """Process all available input; the emitted rows and the last state.

    ``step(batch, state)`` gives the rows of a batch and the state after it; ``state`` and ``rows``
    are their schemas.
    """
    spark = stream.sparkSession
    root = Stage(spark, name).root
    done = {"batch": -1}

    def states(n: int) -> DataFrame:
        return spark.createDataFrame([], state) if n < 0 else spark.read.schema(state).parquet(f"{root}/state/{n}")

    def run(batch: DataFrame, n: int) -> None:
        batch = batch.persist()  # read for the rows and for the state; the source can be read again
        out, after = step(batch, states(n - 1))
        out.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
        after.write.mode("overwrite").parquet(f"{root}/state/{n}")
        batch.unpersist()
        drop_path(spark, f"{root}/state/{n - 2}")
        done["batch"] = n

    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    if done["batch"] < 0:
        return spark.createDataFrame([], rows), states(-1)
    return spark.read.schema(rows).parquet(*[
        f"{root}/out/batch={n}" for n in range(done["batch"] + 1)]), states(done["batch"])


def _with_carried(batch: DataFrame, state: DataFrame, *more: str) -> DataFrame:
    """Rows of the batch that are not late, and the carried row of every series as its first one."""
    last = state.select("series", F.col("ts").alias("__last"))
    fresh = batch.join(last, "series", "left").where("__last IS NULL OR ts >= __last").drop("__last").withColumn(
        "carried", F.lit(False))
    return fresh.unionByName(
        state.select("series", "ts", *more).withColumn("carried", F.lit(True)), allowMissingColumns=True)


def counter_step(batch: DataFrame, state: DataFrame, chunk: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Increase of every sample over the one before, a fall counting from 0: ``series, ts, delta``.

    ``batch`` has ``series, ts, value``; the first sample of a series gives 0.
    """
    rows = previous(_with_carried(batch, state, "value"), ["series"], ["value"], [F.desc("carried"), "value"], chunk)
    gain = F.when(F.col("value") >= F.col("p_value"), F.col("value") - F.col("p_value")).otherwise(F.col("value"))
    after = rows.groupBy("series").agg(F.max(F.struct("ts", F.col("carried") == F.lit(False), "value")).alias("s"))
    return (rows.where("NOT carried").select(
                "series", "ts", F.when(F.col("p_value").isNotNull(), gain).otherwise(0.0).alias("delta")),
            after.select("series", F.col("s.ts").alias("ts"), F.col("s.value").alias("value")))


def alert_step(for_seconds: int, step_seconds: int = 30, chunk: str = "1 day") -> Step:
    """State changes as evaluations arrive: ``series, ts, state`` from ``series, ts, breach``.

    The rules are those of ``alerts.alert_for``: a gap above the step resets an alert, the first calm
    evaluation after a firing one is resolved.
    """
    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = state.select("series", "ts", F.col("state").alias("was"), F.lit(True).alias("carried"))
        last = state.select("series", F.col("ts").alias("__last"))
        fresh = batch.join(last, "series", "left").where("__last IS NULL OR ts > __last").select(
            "series", "ts", "breach", F.lit(None).cast("timestamp").alias("begun"))
        evals = fresh.unionByName(state.select("series", "ts", "breach", F.col("since").alias("begun")))
        rows = alert_for(evals, ["series"], for_seconds, step_seconds, chunk, begun="begun").join(
            known, ["series", "ts"], "left").withColumn("state", F.coalesce("was", "state"))
        rows = previous(rows, ["series"], ["state"], [], chunk)
        after = rows.groupBy("series").agg(F.max_by(F.struct("ts", "breach", "since", "state"), "ts").alias("s"))
        changed = F.col("state") != F.coalesce("p_state", F.lit("inactive"))
        return rows.where(F.col("carried").isNull() & changed).select("series", "ts", "state"), after.select(
            "series", "s.ts", "s.breach", "s.since", "s.state")
    return step


def liveness_step(max_gap_seconds: int = 60, chunk: str = "1 day") -> Step:
    """Times without a sample above the limit, known with the sample that ends them:
    ``series, last_seen, down_from, down_until``.

    Series that are silent to the end stay in the state; ``silent`` lists them at a given time.
    """
    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = _with_carried(batch.select("series", "ts"), state)
        return (up_check(rows, ["series"], max_gap_seconds, chunk),
                rows.groupBy("series").agg(F.max("ts").alias("ts")))
    return step


def silent(state: DataFrame, now, max_gap_seconds: int = 60) -> DataFrame:
    """Series of a liveness state without a sample for longer than the limit: ``series, last_seen``."""
    late = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("ts")
    return state.where(late > max_gap_seconds * 1000000).select("series", F.col("ts").alias("last_seen"))


def progress_step(ttl: str | None = None) -> Step:
    """Latest update of the jobs in a batch, as upserts: ``analysis_id, status, progress, ts``.

    An update older than the known one changes nothing.  With ``ttl`` a job leaves the state once its
    last update is that much older than the newest update seen; its last upsert stays in the rows, so
    ``job_progress`` of the rows is the whole answer.
    """
    def step(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        columns = ["analysis_id", "status", F.col("progress").cast("int").alias("progress"), "ts"]
        new = job_progress(batch.select(*columns))
        merged = job_progress(new.union(state.select(*columns)))
        upserts = merged.join(new.select("analysis_id", "ts", "progress"), ["analysis_id", "ts", "progress"],
                              "left_semi").select(*columns)
        if ttl is not None:
            newest = merged.agg((F.max("ts") - F.expr(f"INTERVAL {ttl}")).alias("__least"))  # one row
            merged = merged.join(F.broadcast(newest), F.col("ts") >= F.col("__least")).drop("__least")
        return upserts, merged.select(*columns)
    return step
