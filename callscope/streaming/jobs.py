"""Structured Streaming forms of the result feed and the resource monitor."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.session import shared_dir
from callscope.streaming.machines import AlertMachine, PauseMachine, SettleMachine

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A row of this number is no event: it only moves the stream's time on.
BEAT = -1


def start(spark: SparkSession, writer) -> StreamingQuery:
    """Start a query whose state lies in RocksDB, whatever the session's own store is."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Feed:
    """A table replayed as a stream: parts of rows in order of arrival, released one after the other.

    A row arrives up to ``jitter_seconds`` after its time, so rows are out of order within a part and from part to part. With
    ``beat`` a last part moves the stream's time that many seconds beyond all rows, as a live stream does by going on.
    """

    def __init__(self, rows: DataFrame, order: str, key: str, parts: int = 3, jitter_seconds: int = 0, beat: int | None = None):
        self.spark, self.rows, self.key, self.files = rows.sparkSession, rows, key, 2
        self.home = f"{shared_dir(self.spark)}/feed-{uuid.uuid4().hex}"
        late = F.pmod(F.xxhash64(*rows.columns), F.lit(jitter_seconds * 1_000_000)) if jitter_seconds else F.lit(0)
        arrival = F.unix_micros(F.col(order).cast("timestamp")) + late
        told = rows.agg(F.percentile_approx(arrival, [k / parts for k in range(1, parts)]).alias("c"), F.max(F.col(order).cast("timestamp")).alias("last")).first()
        edges = [None, *sorted(set(told["c"] or [])), None]
        self.parts = []
        for lo, hi in zip(edges, edges[1:]):
            some = rows if lo is None else rows.where(arrival > lo)
            self.parts.append(some if hi is None else some.where(arrival <= hi))
        if beat is not None and told["last"] is not None:
            last = rows.where(F.col(order).cast("timestamp") == told["last"]).limit(1)
            names = {key: F.lit(BEAT).cast(rows.schema[key].dataType), "event_id": F.lit(BEAT).cast("bigint"), order: F.col(order) + F.expr(f"interval {beat} seconds")}
            self.parts.append(last.select(*[names.get(c, F.col(c)).alias(c) for c in rows.columns]))
        self.release(1)  # a stream needs a folder to look at

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.rows.schema).option("maxFilesPerTrigger", self.files).parquet(self.home)

    def release(self, parts: int) -> None:
        """Let the next parts arrive; a row's file has nothing to do with its key."""
        for some in self.parts[:parts]:
            some.repartition(self.files, "event_id").write.mode("append").parquet(self.home)
        self.parts = self.parts[parts:]


def run_available(stream: DataFrame, mode: str, key: list[str] | None = None, feed: Feed | None = None,
                  watch: Callable[[dict], None] | None = None) -> DataFrame:
    """Drain a stream into a table in the shared folder and read it back.

    A feed is released in two halves, and the query stops and starts again from its checkpoint between them. Batches write a
    folder each, so one that is run again overwrites its own rows. Update-mode results are written per batch; the last batch
    of every key holds. ``watch`` is given the progress of each batch, with the rows and bytes that its state holds.
    """
    spark = stream.sparkSession
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{home}/out/part={batch}")

    halves = [0] if feed is None else [(len(feed.parts) + 1) // 2, len(feed.parts)]
    for parts in halves:
        if feed is not None:
            feed.release(parts)
        q = start(spark, stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/state").outputMode(mode).trigger(availableNow=True))
        q.awaitTermination()
        for p in q.recentProgress if watch else []:
            watch(p)
    out = spark.read.parquet(f"{home}/out")
    if mode == "append":
        return out.drop("_batch", "part")
    rest = [c for c in out.columns if c not in (*key, "_batch", "part")]
    return out.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*key, "r.*")


def state_size(progress: dict) -> tuple[int, int]:
    """Rows and bytes that the state of all operators holds after a batch."""
    kept = progress["stateOperators"]
    return sum(s["numRowsTotal"] for s in kept), sum(s["memoryUsedBytes"] for s in kept)


def unique(feed: DataFrame, key: str = "request_key") -> DataFrame:
    """The feed with each key once, however late a repeat comes: the first row to arrive holds.

    Keys are looked up one by one in the state store, so what a batch reads grows with the batch, not with what is stored.
    """
    return feed.dropDuplicates([key])


def arm_counts(feed: DataFrame, by: str) -> DataFrame:
    return feed.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def stream_progress(feed: DataFrame, plan: DataFrame, key: str = "request_key") -> DataFrame:
    """Planned keys arriving on the stream, counted per family (stream-static join)."""
    return feed.join(plan, key).groupBy("family").agg(F.count(F.lit(1)).alias("seen"))


def completion_gate(seen: DataFrame, plan: DataFrame) -> DataFrame:
    want = plan.groupBy("family").agg(F.count(F.lit(1)).alias("planned"))
    return want.join(seen, "family", "left").select("family", "planned", F.coalesce("seen", F.lit(0)).alias("seen")).withColumn(
        "complete", F.expr("planned = seen"))


def telemetry_windows(samples: DataFrame, width: str, delay: str, ts: str = "ts") -> DataFrame:
    """Windowed roll-up with a watermark; rows later than the delay are dropped."""
    from callscope.operators.telemetry import telemetry_summary
    return telemetry_summary(samples.withWatermark(ts, delay), width, ts)


def stream_alerts(samples: DataFrame, page: int, threshold: float = 1.0, k: int = 3, delay_seconds: int = 0, idle_seconds: int = 86400) -> DataFrame:
    """Rate and consecutive-hot count per stream. samples: user_id, event_id, ts, counter.

    Rows wait in the state until the watermark has passed them and are then taken in the order of time, however the files
    came; a row that is later than ``delay_seconds`` is dropped. A stream that pauses for longer than ``idle_seconds`` is
    forgotten and begins anew.
    """
    machine = AlertMachine(page, threshold, k, idle_seconds)
    held = samples.selectExpr("user_id", "event_id", "ts", "counter AS value").withWatermark("ts", f"{delay_seconds} seconds")
    return held.groupBy("user_id").transformWithStateInPandas(machine, machine.OUT, "append", "EventTime")


def stream_pauses(samples: DataFrame, k: int = 3, limit_seconds: float = 900, delay_seconds: int = 0, idle_seconds: int = 86400) -> DataFrame:
    """pause / continue / stop events per stream. samples: user_id, event_id, ts, pressure; order and idleness as for alerts."""
    machine = PauseMachine(k, limit_seconds, idle_seconds)
    held = samples.selectExpr("user_id", "event_id", "ts", "cast(pressure as bigint) AS value").withWatermark("ts", f"{delay_seconds} seconds")
    return held.groupBy("user_id").transformWithStateInPandas(machine, machine.OUT, "append", "EventTime")


def stream_settle(samples: DataFrame, k: int = 3, limit_seconds: float = 90, delay_seconds: int = 0, idle_seconds: int = 86400) -> DataFrame:
    """settled or timeout, once per run of a stream. samples: user_id, event_id, ts, pressure; order and idleness as for alerts."""
    machine = SettleMachine(k, limit_seconds, idle_seconds)
    held = samples.selectExpr("user_id", "event_id", "ts", "cast(pressure as bigint) AS value").withWatermark("ts", f"{delay_seconds} seconds")
    return held.groupBy("user_id").transformWithStateInPandas(machine, machine.OUT, "append", "EventTime")


def rate_windows(rates: DataFrame, width: str, delay: str) -> DataFrame:
    """Highest level, growth and rate per window, of the rows that the rate job gives: its second stateful step."""
    from callscope.operators.telemetry import rate_summary
    return rate_summary(rates.withWatermark("ts", delay), width)
