"""State machines of the monitor: rows of a stream in the order of time, whatever order they arrive in."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


class InOrder(StatefulProcessor):
    """Rows wait as state until the watermark has passed them; an event-time timer then hands them on in order.

    What waits is bounded by the watermark's delay. The machine's own state is a few numbers, removed once a stream has been
    silent for ``idle_seconds``; a gap longer than that begins a new run also where the timer has not fired yet.
    """

    #: State of the machine, its output columns, and where a run begins.
    STATE, OUT, FRESH = "", "", ()

    def __init__(self, idle_seconds: float):
        self.idle = int(idle_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, so that a stream costs one read and one write a call
        self.kept = handle.getValueState("kept", f"held array<struct<micros:bigint,event_id:bigint,value:bigint>>, last bigint, {self.STATE}")

    def close(self) -> None:
        pass

    def step(self, state: list, micros: int, event: int, value: int) -> Iterator[tuple]:
        """Change the state by one row and yield the rows it gives."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = []
        for some in rows:
            micros = some["ts"].astype("datetime64[us]").astype("int64")
            new += [(int(t), int(e), int(v)) for t, e, v in zip(micros, some["event_id"], some["value"]) if e >= 0]
        if new:
            held, *state = self.kept.get() or ([], None, *self.FRESH)
            self.kept.update(([*(tuple(r) for r in held), *new], *state))
            self.handle.registerTimer(-(-max(new)[0] // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held, last, *state = self.kept.get() or ([], None, *self.FRESH)
        held = sorted(tuple(r) for r in held)
        due = [r for r in held if r[0] <= passed]
        if not due:
            if not held and last is not None and last + self.idle <= passed:
                self.kept.clear()
            return
        out = []
        for micros, event, value in due:
            if last is not None and micros - last > self.idle:
                state = list(self.FRESH)
            out += [(key[0], event, micros, *r) for r in self.step(state, micros, event, value)]
            last = micros
        if len(held) == len(due) and last + self.idle <= passed:
            self.kept.clear()
        else:
            self.kept.update((held[len(due):], last, *state))
            self.handle.registerTimer(-(-(last + self.idle) // 1000))
        yield self.frame(out)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in self.OUT.split(", ")]
        df = pd.DataFrame(rows, columns=names)
        df["ts"] = pd.to_datetime(df["ts"], unit="us")
        floats = [c.split()[0] for c in self.OUT.split(", ") if c.endswith(" double")]
        return df.astype({c: "float64" for c in floats})


class AlertMachine(InOrder):
    """Rate since the sample before, growth since a run's first, and how many rates in a row reached the threshold."""

    STATE = "counter bigint, hot bigint, base bigint, at bigint"
    OUT = "user_id bigint, event_id bigint, ts timestamp, rate double, hot_samples bigint, alert boolean, growth bigint"
    FRESH = (None, 0, None, None)

    def __init__(self, page: int, threshold: float, k: int, idle_seconds: float):
        super().__init__(idle_seconds)
        self.page, self.threshold, self.k = page, threshold, k

    def step(self, state: list, micros: int, event: int, value: int) -> Iterator[tuple]:
        counter, hot, base, at = state
        rate = None
        if counter is not None and micros > at:
            rate = max(0, value - counter) * self.page / 1048576.0 / ((micros - at) / 1e6)
            hot = hot + 1 if rate >= self.threshold else 0
        base = value if base is None else base
        state[:] = value, hot, base, micros
        yield rate, hot, hot >= self.k, value - base


class PauseMachine(InOrder):
    """pause at the first warning, continue after k clean samples in a row, stop once a pause outlasts the limit."""

    STATE = "since bigint, clean bigint, stopped boolean"
    OUT = "user_id bigint, event_id bigint, ts timestamp, event string, pause_seconds double"
    FRESH = (None, 0, False)

    def __init__(self, k: int, limit_seconds: float, idle_seconds: float):
        super().__init__(idle_seconds)
        self.k, self.limit = k, limit_seconds

    def step(self, state: list, micros: int, event: int, value: int) -> Iterator[tuple]:
        since, clean, stopped = state
        if stopped:
            return
        if value != 1:
            clean = 0
            if since is None:
                since = micros
                yield "pause", None
        elif since is not None:
            clean += 1
            if clean == self.k:
                yield "continue", (micros - since) / 1e6
                since, clean = None, 0
        if since is not None and (micros - since) / 1e6 >= self.limit:
            stopped = True
            yield "stop", (micros - since) / 1e6
        state[:] = since, clean, stopped


class SettleMachine(InOrder):
    """settled at the k-th normal sample in a row, timeout at the first sample past the limit, whichever comes first."""

    STATE = "since bigint, clean bigint, done boolean"
    OUT = "user_id bigint, event_id bigint, ts timestamp, state string"
    FRESH = (None, 0, False)

    def __init__(self, k: int, limit_seconds: float, idle_seconds: float):
        super().__init__(idle_seconds)
        self.k, self.limit = k, limit_seconds

    def step(self, state: list, micros: int, event: int, value: int) -> Iterator[tuple]:
        since, clean, done = state
        if done:
            return
        since = micros if since is None else since
        clean = clean + 1 if value == 1 else 0
        verdict = "settled" if clean == self.k else "timeout" if (micros - since) / 1e6 >= self.limit else None
        state[:] = since, clean, verdict is not None
        if verdict:
            yield (verdict,)
