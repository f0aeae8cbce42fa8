"""Queries on the event table as service samples: rates, alerts, progress, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcgraph.plans.registry import query
from srcgraph.plans.views import EVENTS, events, table
from srcgraph.schemas import AUDIT
from srcgraph.sinks.report import write_audit
from srcgraph.sources import logs
from srcgraph.stage import Stage, staged_once
from srcgraph.streaming import alerts, carried, windows
from srcgraph.streaming.run import drain

HOUR, HALF = "1 hour", "30 minutes"

# sliding windows of one hour every 30 minutes
SLIDE = EVENTS + """,
w AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS window_start
      FROM ev, (SELECT unnest([0, 1]) AS i))"""
END = "window_start + INTERVAL 1 HOUR AS window_end"


@query("rate", SLIDE + f"""
SELECT window_start, {END}, event_type, count(*) AS events, count(*) / 3600 AS rate FROM w GROUP BY ALL""")
def rate(spark, sf):
    return windows.rate(events(spark, sf), ["event_type"], HOUR, HALF)


@query("counter_rate", SLIDE + f""",
x AS (SELECT window_start, host, value, lag(value) OVER (PARTITION BY window_start, host ORDER BY ts, value)
      AS prev FROM w)
SELECT window_start, {END}, host,
  round(sum(CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END), 5) AS increase
FROM x GROUP BY window_start, host HAVING count(*) > 1""")
def counter_rate(spark, sf):
    return windows.counter_rate(events(spark, sf), ["host"], HOUR, HALF).drop("rate").withColumn(
        "increase", F.round("increase", 5))


@query("error_ratio", SLIDE + f"""
SELECT window_start, {END}, count(*) FILTER (status = 'error') AS part, count(status) AS whole,
  count(*) FILTER (status = 'error') / count(status) AS error_ratio FROM w
GROUP BY window_start HAVING count(status) > 0""")
def error_ratio(spark, sf):
    return windows.error_ratio(events(spark, sf), None, HOUR, HALF)


@query("hit_ratio", SLIDE + f"""
SELECT window_start, {END}, host, count(*) FILTER (outcome = 'hit') AS part, count(outcome) AS whole,
  count(*) FILTER (outcome = 'hit') / count(outcome) AS hit_ratio FROM w
GROUP BY window_start, host HAVING count(outcome) > 0""")
def hit_ratio(spark, sf):
    return windows.hit_ratio(events(spark, sf), ["host"], HOUR, HALF)


def _quantile_sql(q: float) -> str:
    """Interpolated quantile from the cumulative counts b0.. of the bounds."""
    cases = []
    for i, bound in enumerate(windows.BUCKETS):
        low, below = (0, "0") if i == 0 else (windows.BUCKETS[i - 1], f"b{i - 1}")
        cases.append(f"WHEN b{i} >= {q} * total THEN {low} + ({bound} - {low}) * "
                     f"CASE WHEN b{i} > {below} THEN ({q} * total - {below}) / (b{i} - {below}) ELSE 1 END")
    return "CASE " + " ".join(cases) + f" ELSE {windows.BUCKETS[-1]} END"


COUNTS = ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(windows.BUCKETS))
HISTOGRAM = EVENTS + f""",
h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS total, {COUNTS} FROM ev GROUP BY 1)"""


@query("histogram_quantile", HISTOGRAM + f"""
SELECT window_start, {END}, round({_quantile_sql(0.5)}, 5) AS p50, round({_quantile_sql(0.95)}, 5) AS p95,
  round({_quantile_sql(0.99)}, 5) AS p99 FROM h""")
def histogram_quantile(spark, sf):
    got = windows.histogram_quantile(events(spark, sf), [0.5, 0.95, 0.99], None, HOUR, None)
    return got.select("window_start", "window_end", *[F.round(p, 5).alias(p) for p in ("p50", "p95", "p99")])


@query("threshold_alert", HISTOGRAM + f"""
SELECT window_start, {_quantile_sql(0.5)} > 45 AS breach FROM h""")
def threshold_alert(spark, sf):
    got = windows.histogram_quantile(events(spark, sf), [0.5], None, HOUR, None)
    return windows.threshold_alert(got, "p50", ">", 45.0).select("window_start", "breach")


@query("evaluate_rules", EVENTS + """,
m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, host,
  count(*) FILTER (status = 'error') / nullif(count(status), 0) AS er,
  count(*) FILTER (outcome = 'hit') / nullif(count(outcome), 0) AS hr FROM ev GROUP BY 1, 2)
SELECT 'HighErrorRate' AS alert, ts, host AS labels, er > 0.05 AS breach FROM m WHERE er IS NOT NULL
UNION ALL SELECT 'CriticalErrorRate', ts, host, er > 0.2 FROM m WHERE er IS NOT NULL
UNION ALL SELECT 'LowCacheHitRatio', ts, host, hr < 0.5 FROM m WHERE hr IS NOT NULL""")
def evaluate_rules(spark, sf):
    ev = events(spark, sf)

    def measure(df, name):
        return df.select(F.col("window_start").alias("ts"), F.lit(name).alias("measure"),
                         F.col("host").alias("labels"), F.col(name).alias("value"))

    rows = measure(windows.error_ratio(ev, ["host"], HOUR, None), "error_ratio").unionByName(
        measure(windows.hit_ratio(ev, ["host"], HOUR, None), "hit_ratio"))
    return windows.evaluate_rules(rows).select("alert", "ts", "labels", "breach")


# a breach is a value above 50; it fires after one hour without a gap above 30 minutes
STATES = EVENTS + """,
p AS (SELECT host, ts, value > 50 AS breach, lag(ts) OVER o AS p_ts, lag(value > 50) OVER o AS p_breach
      FROM ev WINDOW o AS (PARTITION BY host ORDER BY ts)),
l AS (SELECT *, coalesce(p_breach AND ts - p_ts <= INTERVAL 30 MINUTE, false) AS linked FROM p),
s AS (SELECT *, max(CASE WHEN breach AND NOT linked THEN ts END) OVER (
  PARTITION BY host ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM l),
st AS (SELECT host, ts, breach, since, CASE WHEN breach AND ts - since >= INTERVAL 1 HOUR THEN 'firing'
  WHEN breach THEN 'pending' WHEN linked AND p_ts - since >= INTERVAL 1 HOUR THEN 'resolved'
  ELSE 'inactive' END AS state FROM s)"""


@query("alert_for", STATES + """
SELECT host, ts, breach, CASE WHEN breach THEN since END AS since, state FROM st""")
def alert_for(spark, sf):
    evals = events(spark, sf).select("host", "ts", (F.col("value") > 50).alias("breach"))
    return alerts.alert_for(evals, ["host"], 3600, 1800)


@query("up_check", EVENTS + """,
g AS (SELECT host, ts AS last_seen, lead(ts) OVER (PARTITION BY host ORDER BY ts) AS down_until
      FROM (SELECT DISTINCT host, ts FROM ev))
SELECT host, last_seen, last_seen + INTERVAL 1 HOUR AS down_from, down_until FROM g
WHERE down_until - last_seen > INTERVAL 1 HOUR""")
def up_check(spark, sf):
    return alerts.up_check(events(spark, sf), ["host"], 3600)


PROGRESS = EVENTS + """,
pe AS (SELECT ts, 'a' || user_id AS analysis_id,
  CASE event_type WHEN 'click' THEN 'validating' WHEN 'view' THEN 'discovering' WHEN 'signup' THEN 'parsing'
    WHEN 'purchase' THEN 'building_graph' ELSE 'analyzing' END AS status,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 10 WHEN 'signup' THEN 30 WHEN 'purchase' THEN 60
    ELSE 80 END AS progress FROM ev)"""


def _progress(spark, sf):
    return _progress_rows(events(spark, sf))


def _progress_rows(ev):
    kind = F.col("event_type")
    stage = F.when(kind == "click", "validating").when(kind == "view", "discovering").when(
        kind == "signup", "parsing").when(kind == "purchase", "building_graph").otherwise("analyzing")
    level = F.create_map(*[F.lit(x) for pair in windows.STAGES.items() for x in pair])
    return ev.select(
        "ts", F.concat(F.lit("a"), "user_id").alias("analysis_id"), stage.alias("status"),
        level[stage].alias("progress"))


@query("job_progress", PROGRESS + """
SELECT analysis_id, arg_max(status, ts) AS status, arg_max(progress, ts) AS progress, max(ts) AS ts
FROM pe GROUP BY 1""")
def job_progress(spark, sf):
    return windows.job_progress(_progress(spark, sf))


@query("progress_fanout", PROGRESS + """
SELECT 'c' || c_custkey AS subscriber, count(*) AS updates, max(progress) AS furthest
FROM pe JOIN customer ON analysis_id = 'a' || (c_custkey % 997) GROUP BY 1""")
def progress_fanout(spark, sf):
    subs = table(spark, sf, "customer").select(
        F.concat(F.lit("a"), F.col("c_custkey") % 997).alias("analysis_id"),
        F.concat(F.lit("c"), "c_custkey").alias("subscriber"))
    return windows.progress_fanout(_progress(spark, sf), subs).groupBy("subscriber").agg(
        F.count(F.lit(1)).alias("updates"), F.max("progress").alias("furthest"))


AUDITED = EVENTS + """,
au AS (SELECT ts, event_id, 'u' || user_id AS username,
  CASE event_type WHEN 'error' THEN 'access_denied' WHEN 'signup' THEN 'login_failed' WHEN 'click' THEN 'login'
    WHEN 'view' THEN 'analysis_read' ELSE 'analysis_create' END AS action,
  CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'warning' ELSE 'info' END AS level,
  event_type NOT IN ('error', 'signup') AS success FROM ev)"""


def _audit(spark, sf):
    kind, v = F.col("event_type"), F.col("value")
    fields = {
        "timestamp": F.col("ts"), "request_id": F.col("event_id").cast("string"),
        "action": F.when(kind == "error", "access_denied").when(kind == "signup", "login_failed").when(
            kind == "click", "login").when(kind == "view", "analysis_read").otherwise("analysis_create"),
        "level": F.when(v > 200, "critical").when(v > 100, "warning").otherwise("info"),
        "username": F.concat(F.lit("u"), "user_id"), "user_roles": F.array(F.lit("analyst")),
        "details": F.create_map(F.lit("value"), v.cast("string")),
        "success": ~kind.isin("error", "signup"),
    }
    return events(spark, sf).select(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in AUDIT.fields])


@query("scan_audit", AUDITED + "SELECT event_id::VARCHAR AS request_id, action, level, username, success FROM au")
def scan_audit(spark, sf):
    path = Stage(spark, "audit").root
    write_audit(_audit(spark, sf), path)
    return logs.scan_audit(spark, path).select("request_id", "action", "level", "username", "success")


@query("write_audit", AUDITED + "SELECT action, 2 * count(*) AS entries FROM au GROUP BY 1")
def write_audit_query(spark, sf):
    path = Stage(spark, "audit").root
    write_audit(_audit(spark, sf), path)
    write_audit(_audit(spark, sf), path)
    return logs.scan_audit(spark, path).groupBy("action").agg(F.count(F.lit(1)).alias("entries"))


@query("audit_summary", AUDITED + f"""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, action, level, success, count(*) AS entries
FROM au GROUP BY ALL""")
def audit_summary(spark, sf):
    return windows.audit_summary(_audit(spark, sf), "1 day").drop("window_end")


@query("audit_by_user", AUDITED + """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, username,
  count(*) FILTER (action = 'login_failed') AS failed_logins, count(*) FILTER (action = 'access_denied') AS denials
FROM au WHERE action IN ('login_failed', 'access_denied') GROUP BY 1, 2""")
def audit_by_user(spark, sf):
    return windows.audit_by_user(_audit(spark, sf), "1 day").drop("window_end")


@query("scan_metric_samples", EVENTS + """
SELECT host, event_type AS metric, count(*) AS samples, round(sum(value), 3) AS total FROM ev GROUP BY 1, 2""")
def scan_metric_samples(spark, sf):
    path = Stage(spark, "samples").root
    events(spark, sf).select("ts", F.col("event_type").alias("metric"), F.create_map(
        F.lit("host"), F.col("host")).alias("labels"), "value").write.json(path)
    return logs.scan_metric_samples(spark, path).groupBy(
        F.col("labels")["host"].alias("host"), "metric").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 3).alias("total"))


# --- the same operators on a stream -----------------------------------------------------------

CLOSED = " AND window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE"


def _raw_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        sf).withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, sf):
    """The event table as a stream."""
    kind = F.col("event_type")
    return _raw_stream(spark, sf).select(
        "event_id", "ts", "event_type", "value",
        F.when(kind == "error", "error").when(kind == "purchase", "success").alias("status"),
        F.concat(F.lit("host"), F.col("user_id") % 5).alias("host"))


@query("rate_stream", SLIDE + f"""
SELECT window_start, event_type, count(*) AS events FROM w WHERE true {CLOSED} GROUP BY 1, 2""")
def rate_stream(spark, sf):
    got = windows.rate(windows.watermarked(_stream(spark, sf)), ["event_type"], HOUR, HALF)
    return drain(got, "rate").select("window_start", "event_type", "events")


@query("error_ratio_stream", SLIDE + f"""
SELECT window_start, count(*) FILTER (status = 'error') / count(status) AS error_ratio FROM w
WHERE true {CLOSED} GROUP BY 1 HAVING count(status) > 0""")
def error_ratio_stream(spark, sf):
    got = windows.error_ratio(windows.watermarked(_stream(spark, sf)), None, HOUR, HALF)
    return drain(got, "ratio").select("window_start", "error_ratio")


SLICES = 4


def _arriving(spark, sf):
    """The event table as a stream of ``SLICES`` batches that arrive in order of time."""
    def write():
        ev = events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value", "host")
        at = [i / SLICES for i in range(1, SLICES)]
        cuts = ev.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), at).alias("c")).first()["c"]
        micros, path = F.unix_micros(F.col("ts").cast("timestamp")), Stage(spark, "arriving").root
        borders = [None, *(cuts or []), None]
        for low, high in zip(borders[:-1], borders[1:], strict=True):
            part = ev if low is None else ev.where(micros > low)
            part = part if high is None else part.where(micros <= high)
            part.coalesce(1).write.mode("append").parquet(path)
        return spark.createDataFrame([(path,)], "path STRING")

    path = staged_once(spark, "arriving", sf, write).first()["path"]
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(
        path).withColumn("ts", F.col("ts").cast("timestamp"))


@query("counter_stream", EVENTS + """,
x AS (SELECT host AS series, ts, value, lag(value) OVER (PARTITION BY host ORDER BY ts) AS prev FROM ev)
SELECT series, ts, round(CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END, 5)
  AS delta FROM x""")
def counter_stream(spark, sf):
    samples = _arriving(spark, sf).select(F.col("host").alias("series"), "ts", F.col("value").cast("double").alias("value"))
    rows, _ = carried.drain_carried(samples, "deltas", carried.counter_step, carried.COUNTER,
                                    "series STRING, ts TIMESTAMP, delta DOUBLE")
    return rows.withColumn("delta", F.round("delta", 5))


@query("alert_stream", STATES + """,
c AS (SELECT host AS series, ts, state, lag(state, 1, 'inactive') OVER (PARTITION BY host ORDER BY ts) AS was
      FROM st)
SELECT series, ts, state FROM c WHERE state <> was""")
def alert_stream(spark, sf):
    evals = _arriving(spark, sf).select(F.col("host").alias("series"), "ts", (F.col("value") > 50).alias("breach"))
    return carried.drain_carried(evals, "alerts", carried.alert_step(3600, 1800), carried.ALERT,
                                 "series STRING, ts TIMESTAMP, state STRING")[0]


@query("liveness_stream", EVENTS + """,
g AS (SELECT host AS series, ts AS last_seen, lead(ts) OVER (PARTITION BY host ORDER BY ts) AS down_until
      FROM (SELECT DISTINCT host, ts FROM ev))
SELECT series, last_seen, last_seen + INTERVAL 1 HOUR AS down_from, down_until FROM g
WHERE down_until - last_seen > INTERVAL 1 HOUR""")
def liveness_stream(spark, sf):
    samples = _arriving(spark, sf).select(F.col("host").alias("series"), "ts")
    return carried.drain_carried(
        samples, "liveness", carried.liveness_step(3600), carried.LIVENESS,
        "series STRING, last_seen TIMESTAMP, down_from TIMESTAMP, down_until TIMESTAMP")[0]


@query("job_progress_stream", PROGRESS + """
SELECT analysis_id, arg_max(status, ts) AS status, arg_max(progress, ts) AS progress, max(ts) AS ts
FROM pe GROUP BY 1""")
def job_progress_stream(spark, sf):
    rows, _ = carried.drain_carried(_progress_rows(_arriving(spark, sf)), "progress",
                                    carried.progress_step("7 DAYS"), carried.PROGRESS, carried.PROGRESS)
    return windows.job_progress(rows)


@query("progress_fanout_stream", PROGRESS + """
SELECT 'c' || c_custkey AS subscriber, ts FROM pe JOIN customer ON analysis_id = 'a' || (c_custkey % 997)""")
def progress_fanout_stream(spark, sf):
    stream = _raw_stream(spark, sf).select(
        "ts", F.concat(F.lit("a"), "user_id").alias("analysis_id"))
    subs = table(spark, sf, "customer").select(
        F.concat(F.lit("a"), F.col("c_custkey") % 997).alias("analysis_id"),
        F.concat(F.lit("c"), "c_custkey").alias("subscriber"))
    return drain(windows.progress_fanout(stream, subs), "fanout").select("subscriber", "ts")
