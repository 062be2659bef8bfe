"""Batch forms of the resource monitor: rates, streaks, pauses, intervals."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.ranking import running_totals
from callscope.operators.stats import top_k

MIB = 1024 * 1024


def micros(col: str) -> str:
    """SQL: microseconds of a timestamp with or without zone."""
    return f"unix_micros(cast({col} as timestamp))"


def numbered(samples: DataFrame, stream: str, ts: str, tie: str) -> DataFrame:
    """Samples with their position in the stream and the previous sample beside them.

    The previous row comes from an equi-join on position, so one long stream spreads over all tasks.
    """
    n = running_totals(samples, [stream], [ts, tie], {"rn": "1"})
    prev = n.select(stream, (F.col("rn") + 1).alias("rn"), *[F.col(c).alias(f"prev_{c}") for c in samples.columns if c != stream])
    return n.join(prev, [stream, "rn"], "left")


def counter_rate(samples: DataFrame, stream: str = "user_id", ts: str = "ts", tie: str = "event_id", counter: str = "counter",
                 page: int = 4096) -> DataFrame:
    """MiB per second since the previous sample, never negative; NULL where no time passed."""
    n = numbered(samples, stream, ts, tie)
    secs = F.expr(f"({micros(ts)} - {micros('prev_' + ts)}) / 1000000.0D")
    return n.withColumn("rate", F.when(secs > 0, F.greatest(F.lit(0), F.col(counter) - F.col(f"prev_{counter}")) * F.lit(page) / F.lit(float(MIB)) / secs))


def streaks(rated: DataFrame, hit: str, reset: str, stream: str = "user_id", out: str = "streak") -> DataFrame:
    """Consecutive hits up to each row: hits so far minus hits at the last reset."""
    d = running_totals(rated, [stream], ["rn"], {"_hits": f"CASE WHEN {hit} THEN 1 ELSE 0 END"})
    d = running_totals(d, [stream], ["rn"], {}, maxima={"_base": f"CASE WHEN {reset} THEN _hits END"})
    return d.withColumn(out, F.col("_hits") - F.coalesce("_base", F.lit(0))).drop("_hits", "_base")


def sustained_alert(samples: DataFrame, k: int = 3, threshold: float = 1.0, page: int = 4096, stream: str = "user_id", **kw) -> DataFrame:
    """Rows with at least k consecutive rates at or above the threshold; a lower rate resets."""
    r = counter_rate(samples, stream=stream, page=page, **kw)
    s = streaks(r, f"rate >= {threshold}", f"rate < {threshold}", stream, "hot_samples")
    return s.withColumn("alert", F.col("hot_samples") >= k)


def settle_detector(samples: DataFrame, k: int = 3, limit_seconds: float = 90, stream: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """settled at the k-th consecutive normal sample, timeout at the first sample past the limit, whichever is first."""
    n = running_totals(samples, [stream], [ts, tie], {"rn": "1"})
    s = streaks(n, "pressure = 1", "pressure <> 1", stream, "clean")
    start = samples.groupBy(stream).agg(F.min(ts).alias("_start"))
    s = s.join(start, stream).withColumn("_late", F.expr(f"({micros(ts)} - {micros('_start')}) / 1000000.0D >= {limit_seconds}"))
    hit = s.where(f"clean = {k} OR _late").groupBy(stream).agg(F.min_by(F.struct("rn", "clean", ts), "rn").alias("h"))
    return samples.select(stream).distinct().join(hit, stream, "left").select(
        stream, F.expr(f"CASE WHEN h IS NULL THEN 'open' WHEN h.clean = {k} THEN 'settled' ELSE 'timeout' END").alias("state"),
        F.col(f"h.{ts}").alias("at"))


def pause_events(samples: DataFrame, k: int = 3, limit_seconds: float = 900, stream: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """pause at the first warning, continue after k clean samples in a row, stop once a pause outlasts the limit.

    A warning opens a pause when none was seen before or the previous sample had completed k clean ones.
    Nothing follows a stop.
    """
    n = running_totals(samples, [stream], [ts, tie], {"rn": "1", "_warns": "CASE WHEN pressure <> 1 THEN 1 ELSE 0 END"})
    s = streaks(n, "pressure = 1", "pressure <> 1", stream, "clean")
    prev = s.select(stream, (F.col("rn") + 1).alias("rn"), F.col("clean").alias("_pc"), F.col("_warns").alias("_pw"))
    s = s.join(prev, [stream, "rn"], "left")
    s = s.withColumn("_open", F.expr(f"pressure <> 1 AND (coalesce(_pw, 0) = 0 OR _pc >= {k})"))
    s = running_totals(s, [stream], ["rn"], {}, maxima={"_since": f"CASE WHEN _open THEN {micros(ts)} END"})
    s = s.withColumn("_paused", F.expr(f"_warns > 0 AND clean < {k}")).withColumn("_secs", F.expr(f"({micros(ts)} - _since) / 1000000.0D"))
    ev = s.withColumn("event", F.explode(F.expr(f"""filter(array(CASE WHEN _open THEN 'pause' END,
        CASE WHEN _warns > 0 AND clean = {k} AND pressure = 1 THEN 'continue' END,
        CASE WHEN _paused AND _secs >= {limit_seconds} THEN 'stop' END), e -> e IS NOT NULL)""")))
    first = ev.where("event = 'stop'").groupBy(stream).agg(F.min("rn").alias("_stop"))
    ev = ev.join(first, stream, "left").where("_stop IS NULL OR rn < _stop OR (rn = _stop AND event IN ('stop', 'pause'))")
    return ev.select(stream, "event", F.col(ts).alias("at"), F.when(F.col("event") != "pause", F.col("_secs")).alias("pause_seconds"))


def growth_cap(samples: DataFrame, baseline: DataFrame, cap: int, stream: str = "user_id", counter: str = "counter") -> DataFrame:
    """Growth over the recorded baseline; identity_error where the counter or boot id does not continue it."""
    j = samples.join(baseline.select(stream, F.col("counter").alias("_b"), F.col("boot").alias("_boot")), stream, "left")
    return j.withColumn("growth", F.expr(f"CASE WHEN _b IS NOT NULL AND boot <=> _boot AND {counter} >= _b THEN {counter} - _b END")).withColumn(
        "verdict", F.expr(f"""CASE WHEN _b IS NULL THEN 'no_baseline' WHEN NOT boot <=> _boot OR {counter} < _b THEN 'identity_error'
            WHEN {counter} - _b > {cap} THEN 'over_cap' ELSE 'ok' END""")).drop("_b", "_boot")


def admission_rows(samples: DataFrame, need: int = 5 * 1024 ** 3) -> DataFrame:
    """Whether a load may start: normal pressure and enough free + inactive + purgeable bytes."""
    return samples.withColumn("available", F.expr("free + inactive + purgeable")).withColumn("admitted", F.expr(f"pressure = 1 AND available >= {need}"))


def largest_processes(processes: DataFrame, group: list[str], k: int = 10) -> DataFrame:
    return top_k(processes, group, [F.desc("resident_bytes"), "name"], k)


def telemetry_summary(samples: DataFrame, width: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Sample count, highest level and growth per window; the same plan serves batch and stream."""
    return (samples.groupBy(F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"), F.max("pressure").alias("max_level"), F.max("counter").alias("max_counter"))
        .select(F.col("w.start").alias("window_start"), "samples", "max_level", "max_counter"))


def rate_summary(rates: DataFrame, width: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """Samples, highest growth over a run's first sample and highest rate per window; one plan for batch and stream."""
    return (rates.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("samples"), F.max("growth").alias("max_growth"), F.max("rate").alias("max_rate"))
            .select(F.col("w.start").alias("window_start"), "samples", "max_growth", "max_rate"))


def event_intervals(events: DataFrame, stream: str = "user_id") -> DataFrame:
    """pause..continue intervals; a pause that meets a stop or the end of the log stays open.

    events: stream, event, at. One row per event, far fewer than samples.
    """
    w = Window.partitionBy(stream).orderBy("at", F.expr("CASE event WHEN 'pause' THEN 0 ELSE 1 END"))
    e = events.withColumn("_next", F.lead(F.struct("event", "at")).over(w))
    return e.where("event = 'pause'").select(stream, F.col("at").alias("paused_at"), F.expr("CASE WHEN _next.event = 'continue' THEN _next.at END").alias("continued_at"),
                                             F.expr("coalesce(_next.event, 'open')").alias("ended_by"))


def stop_chains(log: DataFrame, stream: str = "user_id", ts: str = "at", tie: str = "event_id") -> DataFrame:
    """Pauses of an event log and how each ended: continue, resumable_stop, final_stop or open; and when work was resumed.

    log: stream, event (pause, continue, stop, resume; others are passed over), resumable, at. A stop that is not resumable is
    final, also after a resumable one; nothing counts behind it and a resume is refused. A resume lifts a resumable stop.
    While stopped, pauses and continues don't count; while paused, neither does another pause. What stands before each event is
    known from the last events of each kind, so a long log spreads over all tasks.
    """
    n = running_totals(log.where("event IN ('pause', 'continue', 'stop', 'resume')"), [stream], [ts, tie], {"rn": "1"})
    final = n.where("event = 'stop' AND NOT resumable").groupBy(stream).agg(F.min("rn").alias("_final"))
    live = n.join(final, stream, "left").where("_final IS NULL OR rn <= _final")
    last = lambda when: f"CASE WHEN {when} THEN rn END"
    stops = running_totals(live, [stream], ["rn"], {}, maxima={"_stop": last("event = 'stop'"), "_resume": last("event = 'resume'")})
    # the event itself decides for those behind it: what it finds is what the others left
    stops = stops.withColumn("_stopped", F.expr("""CASE event WHEN 'stop' THEN false WHEN 'resume' THEN coalesce(_stop, 0) > 0
        ELSE coalesce(_stop, 0) > coalesce(_resume, 0) END"""))
    works = stops.where("event IN ('pause', 'continue') AND NOT _stopped OR event = 'stop'")
    works = running_totals(works, [stream], ["rn"], {"_step": "1"}, maxima={"_pause": last("event = 'pause'"), "_close": last("event <> 'pause'")})
    before = works.select(stream, (F.col("_step") + 1).alias("_step"), F.col("event").alias("_before"))
    works = works.join(before, [stream, "_step"], "left").withColumn("_opens", F.expr("event = 'pause' AND NOT _before <=> 'pause'"))
    spans = running_totals(works, [stream], ["rn"], {"_span": "CASE WHEN _opens THEN 1 ELSE 0 END"})
    ends = F.min(F.when(F.col("event") != "pause", F.struct("rn", "event", "resumable", ts)))
    closed = spans.where("_span > 0").groupBy(stream, "_span").agg(F.min(F.when(F.col("_opens"), F.col(ts))).alias("paused_at"), ends.alias("e"))
    # the resume behind a stop is the first one after it: one row per stop
    lifted = running_totals(live.where("event IN ('stop', 'resume')"), [stream], ["rn"], {"_place": "1"}, maxima={"_held": last("event = 'stop'")})
    lifted = lifted.where("event = 'resume' AND _held IS NOT NULL").groupBy(stream, F.col("_held")).agg(F.min(ts).alias("resumed_at"))
    # a run of stops is lifted by the resume behind its last one
    chain = running_totals(live.where("event IN ('stop', 'resume')"), [stream], ["rn"], {"_chain": "CASE WHEN event = 'resume' THEN 1 ELSE 0 END"})
    chain = chain.where("event = 'stop'").select(stream, F.col("rn").alias("_stop_rn"), "_chain")
    of = lifted.join(chain.withColumnRenamed("_stop_rn", "_held"), [stream, "_held"]).select(stream, "_chain", "resumed_at")
    return (closed.withColumn("_stop_rn", F.expr("CASE WHEN e.event = 'stop' THEN e.rn END")).join(chain, [stream, "_stop_rn"], "left").join(of, [stream, "_chain"], "left")
            .select(stream, "paused_at", F.col(f"e.{ts}").alias("ended_at"),
                    F.expr("CASE WHEN e IS NULL THEN 'open' WHEN e.event = 'continue' THEN 'continue' WHEN e.resumable THEN 'resumable_stop' ELSE 'final_stop' END").alias("ended_by"),
                    F.expr("CASE WHEN e.event = 'stop' AND e.resumable THEN resumed_at END").alias("resumed_at")))


def activity_sessions(samples: DataFrame, gap: str = "30 minutes", stream: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of a stream without a longer silence than ``gap``; batch and stream alike."""
    return samples.groupBy(stream, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("samples"), F.max("pressure").alias("max_level")).select(
        stream, F.col("w.start").alias("started_at"), F.expr(f"w.end - interval {gap}").alias("last_at"), "samples", "max_level")
