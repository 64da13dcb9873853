"""Activity segments on an unbounded stream of measurements."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyhouse.operators.segments import SECOND, Rules, micros
from tallyhouse.streaming.state import keep_state_by_key


def stream_sessions(events: DataFrame, threshold: float, gap: str, delay: str) -> DataFrame:
    """Fixed threshold: native session windows, closed by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    active = timed.where(F.col("value") > threshold)
    return active.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("n_active"), F.max("value").alias("peak")
    ).select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"),
             "n_active", "peak")


OUTPUT = "user_id long, start_us long, end_us long, n_active long, peak double"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
RUN = "origin long, start_us long, last_us long, n_active long, peak double, seen_us long, parcel long, wake long"
PARCEL = "us array<long>, ids array<long>, vals array<double>"
#: Event time after which a key that sends nothing is forgotten, with its noise level.
KEEP_US = 365 * 86_400 * SECOND


class Level:
    """Threshold from a low quantile of the latest values, which are kept sorted: a value comes in, one goes out."""

    def __init__(self, rules: Rules, recent: list[float | None]) -> None:
        self.rules, self.recent = rules, deque(recent)
        self.sorted = sorted(v for v in recent if v is not None)

    def take(self, value: float | None) -> float:
        if len(self.recent) == self.rules.window and (gone := self.recent.popleft()) is not None:
            del self.sorted[bisect_left(self.sorted, gone)]
        self.recent.append(value)
        if value is not None:
            insort(self.sorted, value)
        if len(self.sorted) < self.rules.min_history:
            return self.rules.base
        place = (len(self.sorted) - 1) * self.rules.quantile
        low, part = self.sorted[int(place)], place - int(place)
        noise = low if not part else (1 - part) * low + part * self.sorted[int(place) + 1]
        return max(self.rules.base, self.rules.factor * noise)


class Segments(StatefulProcessor):
    """One key. What a batch brings waits as one parcel in a map until the watermark has passed it, so the order of
    arrival does not matter; the latest values are a list, the open segment a value. Event timers wake the key when a
    waiting row is due, when its open segment ends, and when it has been silent for ``keep_us``.

    State is bounded by the rows within the delay and the window of values.
    """

    def __init__(self, rules: Rules, keep_us: int) -> None:
        self.rules, self.keep_us = rules, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)
        self.recent = handle.getListState("recent", "value double")
        self.held = handle.getMapState("held", "first long, parcel long", PARCEL)

    def load(self) -> None:
        start = (-1, -1, -1, 0, 0.0, -1, 0, -1)
        self.origin, self.start, self.last, self.n, self.peak, self.seen, self.parcel, self.wake = (
            self.run.get() if self.run.exists() else start)

    def save(self) -> None:
        self.run.update((int(self.origin), int(self.start), int(self.last), int(self.n), float(self.peak), int(self.seen),
                         int(self.parcel), int(self.wake)))

    def put(self, rows: list[tuple[int, int, float | None]]) -> None:
        """Rows in order of time."""
        us, ids, vals = (list(x) for x in zip(*rows))
        self.held.updateValue((us[0], self.parcel), (us, ids, vals))
        self.parcel += 1

    def wake_at(self, us: int) -> None:
        """Not before the watermark is past ``us``."""
        at = us // 1000 + 1
        if self.wake >= 0:
            self.handle.deleteTimer(self.wake)
        self.handle.registerTimer(at)
        self.wake = at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        part = pd.concat(list(rows))
        values = part["value"].astype(object).where(part["value"].notna(), None)
        came = sorted(zip(part["us"].tolist(), part["event_id"].tolist(), values.tolist()), key=lambda r: r[:2])
        self.put(came)
        if self.wake < 0 or came[0][0] // 1000 + 1 < self.wake:
            self.wake_at(came[0][0])
        self.save()
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.load()
        self.wake = -1
        mark = timerValues.getCurrentWatermarkInMs()
        due, later, done = [], [], []
        for place, parcel in list(self.held.iterator()):
            if place[0] // 1000 >= mark:
                later.append(place[0])
                continue
            rows = list(zip(*parcel))
            self.held.removeKey(tuple(place))
            due += [r for r in rows if r[0] // 1000 < mark]
            if left := [r for r in rows if r[0] // 1000 >= mark]:
                self.put(left)
                later.append(left[0][0])
        if due:
            self.advance(sorted(due, key=lambda r: r[:2]), done)
        if self.n and (self.last + self.rules.gap) // 1000 < mark:
            self.close_segment(done)
            self.origin, self.start, self.last, self.n, self.peak = -1, -1, -1, 0, 0.0
        if not self.n and not later and (self.seen + self.keep_us) // 1000 < mark:
            for state in (self.run, self.recent, self.held):
                state.clear()
        else:
            self.wake_at(min([*later, *([self.last + self.rules.gap] if self.n else [])], default=self.seen + self.keep_us))
            self.save()
        if done:
            yield pd.DataFrame([(key[0], *d) for d in done], columns=COLUMNS)

    def close_segment(self, done: list[tuple]) -> None:
        if self.n >= self.rules.min_active:
            done.append((self.start, self.last, self.n, self.peak))

    def advance(self, rows: list[tuple], done: list[tuple]) -> None:
        """Takes rows in order of time."""
        rules = self.rules
        level = Level(rules, [v[0] for v in self.recent.get()] if self.recent.exists() else [])
        for at, _, value in rows:
            threshold = level.take(value)
            if value is None or not value > threshold:
                continue
            fresh = self.n == 0 or at - self.last > rules.gap
            if fresh or (at - self.origin) // rules.max_length != (self.last - self.origin) // rules.max_length:
                self.close_segment(done)
                self.origin = at if fresh else self.origin
                self.start, self.n, self.peak = at, 0, value
            self.last, self.n, self.peak = at, self.n + 1, max(self.peak, value)
        self.seen = rows[-1][0]
        self.recent.put([(v,) for v in level.recent])

    def close(self) -> None:
        pass


def stream_segments(events: DataFrame, rules: Rules, delay: str, keep_us: int = KEEP_US) -> DataFrame:
    """Adaptive threshold. Rows are taken in order of time once the watermark has passed them; an open segment is
    closed by the watermark. Rows later than ``delay`` are left out, as in any stream with a watermark."""
    keep_state_by_key(events.sparkSession)
    timed = events.withColumn("us", micros(F.col("ts"))).withColumn(
        "ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.select("user_id", "event_id", "ts", "us", "value").groupBy("user_id").transformWithStateInPandas(
        Segments(rules, keep_us), OUTPUT, "Append", "EventTime")
