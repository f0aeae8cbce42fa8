"""Streams give what the batch form gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from srcgraph.sinks import report
from srcgraph.sources import logs
from srcgraph.streaming import alerts, carried, windows
from srcgraph.streaming.run import drain

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def evals(spark, rows):
    return spark.createDataFrame([("s", at(t), b) for t, b in rows], "series STRING, ts TIMESTAMP, breach BOOLEAN")


ROWS = [(0, False), (30, True), (60, True), (90, True), (120, True), (150, False), (180, False),
        (210, True), (300, True), (330, True), (360, True), (390, False), (86400, True), (86430, True),
        (86460, True), (86490, True), (86520, False)]
WANT = ["inactive", "pending", "pending", "firing", "firing", "resolved", "inactive", "pending", "pending",
        "pending", "firing", "resolved", "pending", "pending", "firing", "firing", "resolved"]


def test_alert_batch(spark):
    for chunk in ("1 day", "1 minute", "10 days"):
        got = alerts.alert_for(evals(spark, ROWS), ["series"], 60, 30, chunk).orderBy("ts").collect()
        assert [r.state for r in got] == WANT, chunk


def test_alert_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = evals(spark, ROWS)
    for i in range(4):  # four files, so state carries over batches
        df.orderBy("ts").where(F.pmod(F.floor(F.unix_timestamp("ts") / 1), F.lit(1)) == 0).coalesce(1).where(
            F.col("ts").between(F.lit(at([0, 91, 211, 331][i])), F.lit(at([90, 210, 330, 999999][i])))
        ).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    rows, state = carried.drain_carried(
        stream, "alert", carried.alert_step(60, 30), carried.ALERT, "series STRING, ts TIMESTAMP, state STRING")
    got = rows.orderBy("ts").collect()
    assert [(r.ts, r.breach, r.state) for r in state.collect()] == [(at(86520), False, "resolved")]
    changes = [(ROWS[0][0], s) for s in ()]
    last = "inactive"
    for (t, _), s in zip(ROWS, WANT):
        if s != last:
            changes.append((at(t), s))
        last = s
    assert [(r.ts, r.state) for r in got] == changes


def test_counter(spark):
    rows = [(0, 5.0), (10, 7.0), (40, 1.0), (70, 4.0), (200, 6.0), (400, 9.0)]
    df = spark.createDataFrame([("c", at(t), v) for t, v in rows], "series STRING, ts TIMESTAMP, value DOUBLE")
    got = {(r.window_start - T0).total_seconds(): r.increase
           for r in windows.counter_rate(df, ["series"], "5 minutes", "30 seconds").collect()}
    # from 0: 7-5, reset to 1, 4-1, 6-4
    assert got[0] == 2 + 1 + 3 + 2
    assert got[150] == 3 and 330 not in got


def test_quantile(spark):
    df = spark.createDataFrame([(at(i), float(i)) for i in range(1, 101)], "ts TIMESTAMP, value DOUBLE")
    got = windows.histogram_quantile(df, [0.5, 0.95], None, "1 hour", None).first()
    # rank 50 lies in (30, 60], rank 95 in (60, 120]
    assert got.p50 == 30 + 30 * (50 - 30) / 30
    assert got.p95 == 60 + 60 * (95 - 60) / 40
    assert windows.histogram_quantile(df.where("value > 130"), [0.5], None, "1 hour", None).count() == 0


def test_up_check(spark):
    df = spark.createDataFrame([("t", at(s)) for s in (0, 30, 60, 300, 330, 90000)], "job STRING, ts TIMESTAMP")
    got = alerts.up_check(df, ["job"], 60, until=at(90030)).orderBy("last_seen").collect()
    assert [(r.last_seen, r.down_from, r.down_until) for r in got] == [
        (at(60), at(120), at(300)), (at(330), at(390), at(90000))]
    late = alerts.up_check(df, ["job"], 60, until=at(90100)).count()
    assert late == 3


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ts TIMESTAMP, event_type STRING"
    for rows in ([(at(10), "a"), (at(4000), "a")], [(at(20), "a"), (at(8000), "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = windows.watermarked(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    got = drain(windows.rate(stream, ["event_type"], "1 minute", None), "rate").collect()
    count = {r.window_start: r.events for r in got}
    assert count[at(0)] in (1, 2) and count[at(3960)] == 1 and at(7980) not in count


def test_audit_stream(spark, tmp_path):
    rows = spark.range(6).select(report.audit_row(
        "login_failed", "warning", timestamp=F.lit(at(5)), username=F.concat(F.lit("u"), F.col("id") % 2),
        success=F.lit(False)).alias("a")).select("a.*")
    report.write_audit(rows, str(tmp_path / "log"))
    stream = logs.scan_audit(spark, str(tmp_path / "log"), stream=True)
    q = report.stream_audit(stream, str(tmp_path / "copy"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    back = logs.scan_audit(spark, str(tmp_path / "copy"))
    assert back.count() == 6
    got = {r.username: r.failed_logins for r in windows.audit_by_user(back).collect()}
    assert got == {"u0": 3, "u1": 3}


def test_counter_rate_by_plain_pass(spark):
    rng = random.Random(8)
    rows = [(f"s{rng.randrange(3)}", at(rng.randrange(1200)), float(rng.randrange(50))) for _ in range(400)]
    df = spark.createDataFrame(rows, "series STRING, ts TIMESTAMP, value DOUBLE")
    got = {(r.series, r.window_start): r.increase for r in windows.counter_rate(
        df, ["series"], "5 minutes", "30 seconds").collect()}
    want = {}
    for (series, start) in got:
        end = start + dt.timedelta(minutes=5)
        values = [v for _, v in sorted((t, v) for s, t, v in rows if s == series and start <= t < end)]
        want[series, start] = sum(b - a if b >= a else b for a, b in zip(values, values[1:]))
    assert len(got) > 100 and got == pytest.approx(want)


def arriving(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_counter_stream_carries_the_last_value(spark, tmp_path):
    rng = random.Random(5)
    samples = [(rng.choice("ab"), at(10 * i), float(rng.randrange(40))) for i in range(120)]
    batches = [samples[:31], samples[31:32], samples[32:90], samples[90:] + [("a", at(1), 7.0)]]  # the last one is late
    stream = arriving(spark, str(tmp_path / "in"), batches, "series STRING, ts TIMESTAMP, value DOUBLE")
    rows, state = carried.drain_carried(
        stream, "deltas", lambda b, s: carried.counter_step(b, s, "1 minute"), carried.COUNTER,
        "series STRING, ts TIMESTAMP, delta DOUBLE")
    want, last = {}, {}
    for series, ts, value in samples:
        was = last.get(series)
        want[series, ts] = 0.0 if was is None else value - was if value >= was else value
        last[series] = value
    assert {(r.series, r.ts): r.delta for r in rows.collect()} == want
    assert {r.series: r.value for r in state.collect()} == last


def test_alert_stream_in_any_batches_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(11)
    rows = [(s, at(30 * i), rng.random() < 0.7) for i in range(80) for s in "ab" if rng.random() < 0.95]
    schema = "series STRING, ts TIMESTAMP, breach BOOLEAN"
    cuts = [0, 1, 40, 41, 100, len(rows)]
    stream = arriving(spark, str(tmp_path / "in"), [rows[a:b] for a, b in zip(cuts, cuts[1:])], schema)
    got, _ = carried.drain_carried(stream, "alert", carried.alert_step(90, 30, "10 minutes"), carried.ALERT,
                                   "series STRING, ts TIMESTAMP, state STRING")
    whole = alerts.alert_for(spark.createDataFrame(rows, schema), ["series"], 90, 30).orderBy("series", "ts").collect()
    want, was = set(), {}
    for r in whole:
        if r.state != was.get(r.series, "inactive"):
            want.add((r.series, r.ts, r.state))
        was[r.series] = r.state
    assert {(r.series, r.ts, r.state) for r in got.collect()} == want and len(want) > 20


def test_liveness_stream(spark, tmp_path):
    times = [[0, 30, 60], [300, 330], [90000]]
    stream = arriving(spark, str(tmp_path / "in"), [[("t", at(s)) for s in b] for b in times], carried.LIVENESS)
    rows, state = carried.drain_carried(
        stream, "live", carried.liveness_step(60), carried.LIVENESS,
        "series STRING, last_seen TIMESTAMP, down_from TIMESTAMP, down_until TIMESTAMP")
    assert [(r.last_seen, r.down_from, r.down_until) for r in rows.orderBy("last_seen").collect()] == [
        (at(60), at(120), at(300)), (at(330), at(390), at(90000))]
    assert carried.silent(state, at(90061)).count() == 1 and carried.silent(state, at(90060)).count() == 0


def test_job_progress_stream_takes_updates_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"a{rng.randrange(9)}", "s", i % 90, at(3600 * i)) for i in range(150)]
    rng.shuffle(rows)
    stream = arriving(spark, str(tmp_path / "in"), [rows[i::4] for i in range(4)], carried.PROGRESS)
    want = {r.analysis_id: (r.progress, r.ts) for r in windows.job_progress(
        spark.createDataFrame(rows, carried.PROGRESS)).collect()}
    for ttl in (None, "10 HOURS"):
        got, state = carried.drain_carried(
            stream, "progress", carried.progress_step(ttl), carried.PROGRESS, carried.PROGRESS)
        assert {r.analysis_id: (r.progress, r.ts) for r in windows.job_progress(got).collect()} == want
        kept = {r.analysis_id for r in state.collect()}
        assert kept == set(want) if ttl is None else kept == {k for k, (_, t) in want.items() if t >= at(3600 * 139)}


def test_batch_run_again_gives_the_same_rows(spark):
    first = spark.createDataFrame([("a", at(0), 5.0), ("a", at(10), 9.0)], carried.COUNTER)
    _, state = carried.counter_step(first, spark.createDataFrame([], carried.COUNTER))
    second = spark.createDataFrame([("a", at(20), 3.0), ("b", at(5), 1.0)], carried.COUNTER)
    runs = [sorted(tuple(r) for r in carried.counter_step(second, state)[0].collect()) for _ in range(2)]
    assert runs[0] == runs[1] == [("a", at(20), 3.0), ("b", at(5), 0.0)]
    empty, kept = carried.counter_step(second.limit(0), state)
    assert empty.count() == 0 and kept.count() == 1
