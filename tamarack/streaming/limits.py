"""Stateful rules over event streams: token buckets, daily caps, alerts, repeated sightings, gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def token_bucket(events: DataFrame, key: str, time: str, ident: str, per_second: float, burst: float) -> DataFrame:
    """(key, ident, allowed): an event passes if its key's bucket holds a token; buckets refill with event time.

    For streams; state is two numbers a key. Events of a key in one batch count in time order.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(frames)).sort_values([time, ident])
        passed = []
        for at in (rows[time].astype("int64") / (1e9 if str(rows[time].dtype).startswith("datetime64[ns") else 1e6)).tolist():
            if last is not None:
                tokens = min(burst, tokens + max(0.0, at - last) * per_second)
            last = at if last is None else max(last, at)
            passed.append(tokens >= 1)
            tokens -= passed[-1]
        state.update((float(tokens), last))
        yield pd.DataFrame({key: [k[0]] * len(rows), ident: rows[ident].to_numpy(), "allowed": passed})

    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, {ident} {kinds[ident]}, allowed boolean"
    return events.groupBy(key).applyInPandasWithState(step, out, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def alert_states(conditions: DataFrame, key: str, time: str, fires: str) -> DataFrame:
    """(key, at, action): what a stream of condition reports does to alerts: raise, refresh or clear.

    State is one flag a key: whether its alert stands. Reports of a key in one batch count in time order; a
    condition that does not fire and has no open alert does nothing.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stands = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        out = []
        for at, now in zip(rows[time], rows[fires], strict=True):
            if now or stands:
                out.append((k[0], at, "clear" if not now else "refresh" if stands else "raise"))
            stands = bool(now)
        state.update((stands,))
        yield pd.DataFrame(out, columns=[key, "at", "action"])

    kinds = dict(conditions.dtypes)
    return conditions.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, at {kinds[time]}, action string", "stands boolean", "append", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, key: str, time: str, cap: int, late: str = "1 hour") -> DataFrame:
    """(key, day, n, over) in tumbling days with a watermark: a closed day takes no more events."""
    days = events.withWatermark(time, late).groupBy(key, F.window(time, "1 day")).count()
    return days.select(key, F.col("window.start").alias("day"), F.col("count").alias("n"), (F.col("count") > cap).alias("over"))


def first_sightings(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def quiet_sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): sessions ended by a gap; a run without a heartbeat for so long is stale."""
    found = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).count()
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("n"))


class _Lockout(StatefulProcessor):
    """Failures of a key within a window, and until when it is locked; a timer ends the lock without any event."""

    def __init__(self, key: str, time: str, ok: str, most: int, window: float, lock: float):
        self.key, self.time, self.ok, self.most, self.window, self.lock = key, time, ok, most, window, lock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "times array<double>")
        self.until = handle.getValueState("until", "at double")

    def _told(self, key: tuple, rows: list[tuple[float, str]]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({self.key: [key[0]] * len(rows), "at": pd.to_datetime([round(t * 1e6) for t, _ in rows], unit="us", utc=True), "action": [a for _, a in rows]})

    def _unlock(self, until: float) -> None:
        self.until.clear()
        if round(until * 1000) in set(self.handle.listTimers()):
            self.handle.deleteTimer(round(until * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        times = pd.to_datetime(batch[self.time], utc=True).map(lambda t: t.timestamp())
        recent = list(self.failures.get()[0]) if self.failures.exists() else []
        until = self.until.get()[0] if self.until.exists() else None
        out = []
        for at, ok in sorted(zip(times.tolist(), batch[self.ok].astype(bool).tolist()), key=lambda x: (x[0], x[1])):
            if until is not None and at >= until:
                out.append((until, "unlocked"))
                self._unlock(until)
                until = None
            if until is not None:
                out.append((at, "rejected"))
            elif ok:
                recent = []
                out.append((at, "passed"))
            else:
                recent = [t for t in recent if t > at - self.window] + [at]
                if len(recent) < self.most:
                    out.append((at, "failed"))
                else:
                    recent, until = [], at + self.lock
                    self.until.update((until,))
                    self.handle.registerTimer(round(until * 1000))
                    out.append((at, "locked"))
        if recent:
            self.failures.update((recent,))
        elif self.failures.exists():
            self.failures.clear()
        yield from self._told(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = self.until.get()[0] if self.until.exists() else None
        if until is not None and round(until * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
            yield from self._told(key, [(until, "unlocked")])

    def close(self) -> None:
        pass


def lockouts(events: DataFrame, key: str, time: str, ok: str, most: int = 10, window_seconds: float = 900, lock_seconds: float = 900, late: str = "10 minutes") -> DataFrame:
    """(key, at, action) of a stream of attempts: passed, failed, locked (the ``most``-th failure within the window), rejected (while
    locked) and unlocked, which comes when the watermark passes the end of the lock, whether or not the key is heard of again.

    A success forgets the failures before it. Attempts of a key in one batch count in time order, those later than ``late`` not at
    all. State holds fewer than ``most`` times a key. Needs the RocksDB state store.
    """
    kinds = dict(events.dtypes)
    processor = _Lockout(key, time, ok, most, window_seconds, lock_seconds)
    grouped = events.select(key, time, ok).withWatermark(time, late).groupBy(key)
    return grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"{key} {kinds[key]}, at timestamp, action string", outputMode="Append", timeMode="EventTime")
