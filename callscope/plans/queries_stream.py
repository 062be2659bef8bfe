"""Monitor and feed jobs in batch and streaming form; the checks restate the batch semantics in SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import telemetry as tm
from callscope.plans.fixtures import fixture, table, with_fx
from callscope.plans.registry import query, rounded
from callscope.streaming import jobs

PAGE = 5 * 1024 * 1024
LIMIT = 5 * 86400
HOLD = 10 * 86400


def fx(sql: str, names: str = "fx_telemetry") -> str:
    return with_fx(names, sql)


def samples(df):
    return df.select("user_id", "event_id", "ts", F.col("cents").alias("counter"), "pressure")


def batch(spark, sf):
    return samples(fixture(spark, sf, "fx_telemetry"))


JITTER = 6 * 3600
IDLE = 400 * 86400


def feed(spark, sf, beat: int | None = None, jitter: int = JITTER):
    """The events as a feed whose rows come up to six hours late, with the same derived columns."""
    e = table(spark, sf, "events").selectExpr("user_id", "event_id", "cast(ts as timestamp) AS ts", "cast(round(value * 100) as bigint) AS counter",
                                              "CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS pressure",
                                              "concat(user_id, ':', regexp_extract(props, '([0-9]+)', 1)) AS request_key", "user_id % 10 AS bucket")
    return jobs.Feed(e, "ts", "user_id", jitter_seconds=jitter, beat=beat)


RATES = f""", o AS (SELECT user_id, event_id, ts, pressure, cents AS counter, row_number() OVER w AS rn, lag(cents) OVER w AS pc, lag(ts) OVER w AS pt, min(ts) OVER (PARTITION BY user_id) AS t0
   FROM fx_telemetry WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, CASE WHEN epoch_us(ts) > epoch_us(pt) THEN greatest(0, counter - pc) * {PAGE}::double / 1048576 / ((epoch_us(ts) - epoch_us(pt)) / 1000000.0::double) END AS rate FROM o),
 g AS (SELECT *, count(*) FILTER (WHERE rate >= 1) OVER w AS hits, count(*) FILTER (WHERE rate < 1) OVER w AS resets FROM r WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
 h AS (SELECT *, (hits - min(hits) OVER (PARTITION BY user_id, resets ORDER BY rn) + CASE WHEN resets = 0 THEN first_value(hits) OVER (PARTITION BY user_id, resets ORDER BY rn) ELSE 0 END)::bigint AS hot_samples FROM g)"""


@query("stream_counter_rate_batch", fx(RATES + " SELECT event_id, round(rate, 6) AS rate FROM r"))
def counter_rate(spark, sf):
    return rounded(tm.counter_rate(batch(spark, sf), page=PAGE).select("event_id", "rate"))


@query("stream_sustained_alert_batch", fx(RATES + " SELECT event_id, hot_samples, hot_samples >= 3 AS alert FROM h"))
def sustained_alert(spark, sf):
    return tm.sustained_alert(batch(spark, sf), page=PAGE).select("event_id", "hot_samples", "alert")


@query("stream_alerts", fx(RATES + " SELECT event_id, round(rate, 6) AS rate, hot_samples, hot_samples >= 3 AS alert FROM h"))
def stream_alerts(spark, sf):
    """Shuffled files, a restart in the middle, and a last beat that empties the state."""
    f = feed(spark, sf, beat=2 * IDLE)
    out = jobs.run_available(jobs.stream_alerts(f.stream(), PAGE, delay_seconds=JITTER, idle_seconds=IDLE), "append", feed=f)
    return rounded(out.select("event_id", "rate", "hot_samples", "alert"))


CLEAN = """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, min(ts) OVER (PARTITION BY user_id) AS t0 FROM fx_telemetry),
 c AS (SELECT *, count_if(pressure <> 1) OVER (PARTITION BY user_id ORDER BY rn) AS warns FROM o),
 s AS (SELECT *, count_if(pressure = 1) OVER (PARTITION BY user_id, warns ORDER BY rn) AS clean FROM c)"""


@query("stream_settle", fx(CLEAN + f""", q AS (SELECT *, (epoch_us(ts) - epoch_us(t0)) / 1000000.0::double >= {LIMIT} AS late FROM s),
 f AS (SELECT user_id, min_by(CASE WHEN clean = 3 THEN 'settled' ELSE 'timeout' END, rn) AS state, min_by(ts, rn) AS hit_at FROM q WHERE clean = 3 OR late GROUP BY 1)
SELECT u.user_id, coalesce(state, 'open') AS state, hit_at AS "at" FROM (SELECT DISTINCT user_id FROM fx_telemetry) u LEFT JOIN f USING (user_id)"""))
def stream_settle(spark, sf):
    return tm.settle_detector(batch(spark, sf), 3, LIMIT)


PAUSES = CLEAN + f""", p AS (SELECT *, lag(clean) OVER (PARTITION BY user_id ORDER BY rn) AS pc, lag(warns) OVER (PARTITION BY user_id ORDER BY rn) AS pw FROM s),
 b AS (SELECT *, pressure <> 1 AND (coalesce(pw, 0) = 0 OR pc >= 3) AS opens FROM p),
 d AS (SELECT *, max(CASE WHEN opens THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY rn) AS since FROM b),
 k AS (SELECT *, (epoch_us(ts) - since) / 1000000.0::double AS secs FROM d),
 v AS (SELECT user_id, rn, ts, 'pause' AS event, NULL::double AS secs FROM k WHERE opens
   UNION ALL SELECT user_id, rn, ts, 'continue', secs FROM k WHERE warns > 0 AND clean = 3 AND pressure = 1
   UNION ALL SELECT user_id, rn, ts, 'stop', secs FROM k WHERE warns > 0 AND clean < 3 AND secs >= {HOLD}),
 z AS (SELECT user_id, min(rn) AS halt FROM v WHERE event = 'stop' GROUP BY 1),
 e AS (SELECT v.* FROM v LEFT JOIN z USING (user_id) WHERE halt IS NULL OR rn < halt OR (rn = halt AND event IN ('stop', 'pause')))"""
PAUSE_SQL = fx(PAUSES + " SELECT user_id, event, ts AS at, round(secs, 6) AS pause_seconds FROM e")


@query("stream_pause_batch", PAUSE_SQL)
def pause_batch(spark, sf):
    return rounded(tm.pause_events(batch(spark, sf), 3, HOLD))


@query("stream_pauses", PAUSE_SQL)
def stream_pauses(spark, sf):
    f = feed(spark, sf, beat=2 * IDLE)
    out = jobs.run_available(jobs.stream_pauses(f.stream(), 3, HOLD, JITTER, IDLE), "append", feed=f)
    return rounded(out.select("user_id", "event", F.col("ts").cast("timestamp_ntz").alias("at"), "pause_seconds"))


@query("stream_event_intervals", fx(PAUSES + """, n AS (SELECT *, lead(event) OVER x AS ne, lead(ts) OVER x AS nt FROM e WINDOW x AS (PARTITION BY user_id ORDER BY ts, event <> 'pause'))
SELECT user_id, ts AS paused_at, CASE WHEN ne = 'continue' THEN nt END AS continued_at, coalesce(ne, 'open') AS ended_by FROM n WHERE event = 'pause'"""))
def stream_event_intervals(spark, sf):
    return tm.event_intervals(tm.pause_events(batch(spark, sf), 3, HOLD))


@query("stream_settle_live", fx(CLEAN + f""", q AS (SELECT *, (epoch_us(ts) - epoch_us(t0)) / 1000000.0::double >= {LIMIT} AS late FROM s)
SELECT user_id, min_by(CASE WHEN clean = 3 THEN 'settled' ELSE 'timeout' END, rn) AS state, min_by(ts, rn) AS "at" FROM q WHERE clean = 3 OR late GROUP BY 1"""))
def stream_settle_live(spark, sf):
    f = feed(spark, sf, beat=2 * IDLE)
    out = jobs.run_available(jobs.stream_settle(f.stream(), 3, LIMIT, JITTER, IDLE), "append", feed=f)
    return out.select("user_id", "state", F.col("ts").cast("timestamp_ntz").alias("at"))


# one event after the other: the state before each, and what it does to it
CHAINS = """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY happened, event_id) AS rn FROM fx_event_log),
 m AS (SELECT user_id, 0::bigint AS rn, 'running' AS st, NULL::timestamp AS paused_at, NULL::timestamp AS happened, NULL::varchar AS ended_by, NULL::timestamp AS began FROM (SELECT DISTINCT user_id FROM o)),
 x AS (SELECT * FROM m UNION ALL
  SELECT o.user_id, o.rn, CASE WHEN x.st = 'final' THEN 'final' WHEN o.event = 'stop' AND NOT o.resumable THEN 'final' WHEN o.event = 'stop' THEN 'stopped'
      WHEN x.st = 'stopped' THEN CASE WHEN o.event = 'resume' THEN 'running' ELSE 'stopped' END
      WHEN o.event = 'pause' THEN 'paused' WHEN o.event = 'continue' THEN 'running' ELSE x.st END,
    CASE WHEN x.st = 'running' AND o.event = 'pause' THEN o.happened WHEN x.st = 'paused' AND o.event IN ('pause', 'resume') THEN x.paused_at END, o.happened,
    CASE WHEN x.st = 'paused' THEN CASE WHEN o.event = 'continue' THEN 'continue' WHEN o.event = 'stop' THEN CASE WHEN o.resumable THEN 'resumable_stop' ELSE 'final_stop' END END
         WHEN x.st = 'stopped' AND o.event = 'resume' THEN 'resume' END,
    x.paused_at
  FROM x JOIN o ON o.user_id = x.user_id AND o.rn = x.rn + 1),
 r AS (SELECT c.user_id, c.began AS paused_at, c.happened AS ended_at, c.ended_by,
         CASE WHEN c.ended_by = 'resumable_stop' THEN (SELECT min(y.happened) FROM x y WHERE y.user_id = c.user_id AND y.rn > c.rn AND y.ended_by = 'resume') END AS resumed_at
       FROM x c WHERE c.ended_by IN ('continue', 'resumable_stop', 'final_stop')),
 l AS (SELECT user_id, max_by(st, rn) AS st, max_by(paused_at, rn) AS paused_at FROM x GROUP BY 1)
SELECT * FROM r UNION ALL SELECT user_id, paused_at, NULL, 'open', NULL FROM l WHERE st = 'paused'"""


@query("stream_stop_chains", "WITH RECURSIVE" + fx(CHAINS, "fx_event_log").removeprefix("WITH"))
def stream_stop_chains(spark, sf):
    return tm.stop_chains(fixture(spark, sf, "fx_event_log"), ts="happened")


@query("stream_sessions", fx(""", g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 86400000000, false) AS fresh FROM fx_telemetry),
 n AS (SELECT *, count_if(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, min(ts) AS started_at, max(ts) AS last_at, count(*) AS samples, max(pressure) AS max_level FROM n GROUP BY user_id, run"""))
def stream_sessions(spark, sf):
    return tm.activity_sessions(batch(spark, sf), "1 day")


@query("stream_growth_cap", fx(""", b AS (SELECT user_id, min(cents) AS c, CASE WHEN user_id % 9 = 0 THEN 'old' ELSE 'boot' END AS boot FROM fx_telemetry WHERE user_id % 8 <> 0 GROUP BY 1)
SELECT event_id, CASE WHEN boot = 'boot' THEN cents - c END AS growth, CASE WHEN c IS NULL THEN 'no_baseline' WHEN boot <> 'boot' THEN 'identity_error'
  WHEN cents - c > 5000 THEN 'over_cap' ELSE 'ok' END AS verdict FROM fx_telemetry LEFT JOIN b USING (user_id)"""))
def stream_growth_cap(spark, sf):
    s = batch(spark, sf).withColumn("boot", F.lit("boot"))
    base = s.where("user_id % 8 <> 0").groupBy("user_id").agg(F.min("counter").alias("counter")).withColumn("boot", F.expr("CASE WHEN user_id % 9 = 0 THEN 'old' ELSE 'boot' END"))
    return tm.growth_cap(s, base, 5000).select("event_id", "growth", "verdict")


@query("stream_admission", fx("""SELECT event_id, cents * 1000000 + user_id * 1000000 + 1000 AS available, pressure = 1 AND cents * 1000000 + user_id * 1000000 + 1000 >= 5368709120 AS admitted FROM fx_telemetry"""))
def stream_admission(spark, sf):
    s = batch(spark, sf).selectExpr("event_id", "pressure", "counter * 1000000 AS free", "user_id * 1000000 AS inactive", "cast(1000 as bigint) AS purgeable")
    return tm.admission_rows(s).select("event_id", "available", "admitted")


@query("stream_largest_processes", """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY cast(round(value * 100) AS bigint) DESC, cast(event_id AS string)) AS k FROM events)
SELECT event_type, event_id FROM r WHERE k <= 10""")
def stream_largest_processes(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_type", "event_id", "cast(round(value * 100) as bigint) AS resident_bytes", "cast(event_id as string) AS name")
    return tm.largest_processes(e, ["event_type"]).select("event_type", "event_id")


WINDOWS = fx("""SELECT date_trunc('day', ts) AS window_start, count(*) AS samples, max(pressure) AS max_level, max(cents) AS max_counter FROM fx_telemetry GROUP BY 1""")


@query("stream_summary_batch", WINDOWS)
def summary_batch(spark, sf):
    return tm.telemetry_summary(batch(spark, sf), "1 day")


@query("stream_telemetry_windows", WINDOWS)
def telemetry_windows(spark, sf):
    f = feed(spark, sf)
    s = jobs.telemetry_windows(f.stream().select("ts", "counter", "pressure"), "1 day", f"{JITTER} seconds")
    return jobs.run_available(s, "update", ["window_start"], f).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


ROLLED = fx(RATES + """, w AS (SELECT *, counter - first_value(counter) OVER (PARTITION BY user_id ORDER BY rn) AS growth FROM r)
SELECT date_trunc('day', ts) AS window_start, count(*) AS samples, max(growth) AS max_growth, round(max(rate), 6) AS max_rate FROM w GROUP BY 1""")


@query("stream_rate_summary_batch", ROLLED)
def rate_summary_batch(spark, sf):
    s = batch(spark, sf)
    first = s.groupBy("user_id").agg(F.min_by("counter", F.struct("ts", "event_id")).alias("base"))
    rates = tm.counter_rate(s, page=PAGE).join(first, "user_id").withColumn("growth", F.col("counter") - F.col("base"))
    return rounded(tm.rate_summary(rates, "1 day"))


@query("stream_rate_windows", ROLLED)
def rate_windows(spark, sf):
    """Two stateful steps in a row: rates in order of time, then windows over the rows that the first step gives."""
    f = feed(spark, sf, beat=2 * IDLE)
    rates = jobs.run_available(jobs.stream_alerts(f.stream(), PAGE, delay_seconds=JITTER, idle_seconds=IDLE), "append", feed=f)
    g = jobs.Feed(rates, "ts", "user_id", beat=3 * 86400)
    out = jobs.run_available(jobs.rate_windows(g.stream(), "1 day", f"{JITTER} seconds"), "append", feed=g)
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("stream_results", "SELECT user_id % 10 AS bucket, count(DISTINCT (user_id, regexp_extract(props, '([0-9]+)', 1))) AS n FROM events GROUP BY 1")
def stream_results(spark, sf):
    f = feed(spark, sf)
    return jobs.arm_counts(jobs.run_available(jobs.unique(f.stream().select("request_key", "bucket")), "append", feed=f), "bucket")


@query("stream_progress", """WITH p AS (SELECT event_id, event_type AS family, event_id % 10 <> 0 AS sent FROM events)
SELECT family, count(*) AS planned, count_if(sent)::bigint AS seen, count(*) = count_if(sent) AS complete FROM p GROUP BY 1""")
def stream_progress(spark, sf):
    """Nine of ten planned requests have arrived."""
    plan = table(spark, sf, "events").selectExpr("cast(event_id as string) AS request_key", "event_type AS family")
    f = feed(spark, sf)
    arrived = f.stream().where("event_id % 10 <> 0").select(F.col("event_id").cast("string").alias("request_key"))
    return jobs.completion_gate(jobs.run_available(jobs.stream_progress(arrived, plan), "update", ["family"], f), plan)
