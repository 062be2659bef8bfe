"""Monitor streams: order of time, late rows, restart, expiry; chains of stops."""
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from callscope.operators import telemetry as tm
from callscope.streaming import jobs

T0 = datetime(2024, 1, 1)
MIB = 1024 * 1024


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_alerts_in_order_with_restart_and_expiry(spark):
    """Rows that arrive up to 100 s late give what the batch form gives; a long silence begins anew; nothing stays behind."""
    rows = [(u, u * 1000 + i, at(10 * i + u), (i * (1 + u)) % 7 * 40) for u in range(4) for i in range(60)]
    rows += [(9, 9000 + i, at(10 * i), 50 * i) for i in range(5)] + [(9, 9100 + i, at(5000 + 10 * i), 50 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, counter long").repartition(3)
    seen = []
    feed = jobs.Feed(df, "ts", "user_id", parts=3, jitter_seconds=100, beat=100_000)
    out = jobs.run_available(jobs.stream_alerts(feed.stream(), MIB, threshold=4.0, delay_seconds=100, idle_seconds=1000), "append", feed=feed,
                             watch=lambda p: seen.append(jobs.state_size(p)))
    got = {r["event_id"]: (r["rate"], r["hot_samples"], r["alert"]) for r in out.collect()}
    whole = tm.sustained_alert(df.withColumn("user_id", F.expr("user_id + IF(event_id >= 9100, 90, 0)")), 3, 4.0, MIB)
    assert got == {r["event_id"]: (r["rate"], r["hot_samples"], r["alert"]) for r in whole.collect()} and any(v[2] for v in got.values())
    assert max(n for n, _ in seen) > 0 and seen[-1][0] == 0  # state is held while streams go on, and given back


def test_rows_behind_the_watermark_are_dropped(spark):
    rows = [(1, i, at(i), i) for i in range(10)]
    late = [(1, 99, at(2), 5)]
    schema = "user_id long, event_id long, ts timestamp, counter long"
    feed = jobs.Feed(spark.createDataFrame(rows, schema), "ts", "user_id", parts=1, beat=50)
    feed.parts = [feed.parts[0], spark.createDataFrame(late, schema), spark.createDataFrame([(-1, jobs.BEAT, at(500), 0)], schema)]
    out = jobs.run_available(jobs.stream_alerts(feed.stream(), MIB, idle_seconds=60), "append", feed=feed)
    assert sorted(r["event_id"] for r in out.collect()) == list(range(10))


def test_first_row_of_a_key_holds(spark):
    rows = [(i, f"k{i % 7}", at(i)) for i in range(50)]
    feed = jobs.Feed(spark.createDataFrame(rows, "event_id long, request_key string, ts timestamp"), "ts", "event_id", parts=4)
    out = jobs.run_available(jobs.unique(feed.stream()), "append", feed=feed)
    assert sorted(r["request_key"] for r in out.collect()) == [f"k{i}" for i in range(7)]


def test_stop_chains(spark):
    """All four endings, refused and idle events, and a final stop behind a resumable one."""
    log = [(1, "pause", True), (1, "pause", True), (1, "continue", True), (1, "continue", True), (1, "pause", True), (1, "stop", True), (1, "pause", True), (1, "stop", True),
           (1, "resume", True), (1, "resume", True), (1, "pause", True), (1, "stop", False), (1, "resume", True), (1, "pause", True),
           (2, "resume", True), (2, "pause", True), (2, "resume", True), (2, "noted", True),
           (3, "pause", True), (3, "stop", True), (3, "stop", False), (3, "resume", True), (4, "continue", True)]
    df = spark.createDataFrame([(u, i, at(i), e, r) for i, (u, e, r) in enumerate(log)], "user_id long, event_id long, at timestamp, event string, resumable boolean")
    s = lambda i: None if i is None else at(i)
    want = [(1, 0, 2, "continue", None), (1, 4, 5, "resumable_stop", 8), (1, 10, 11, "final_stop", None), (2, 15, None, "open", None), (3, 18, 19, "resumable_stop", None)]
    assert sorted(map(tuple, tm.stop_chains(df).collect()), key=lambda r: r[:2]) == [(u, s(a), s(b), e, s(c)) for u, a, b, e, c in want]
    assert tm.stop_chains(df.limit(0)).collect() == []
