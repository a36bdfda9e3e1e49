"""Error streaks over late and unordered events: rows wait for the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class _Streaks(StatefulProcessor):
    """Per worker the rows that the watermark has not passed, and the streak up to it.

    A timer stands at the earliest waiting row. When it fires, all rows up to
    the watermark are taken in order of time, so the files and triggers that
    brought them do not matter. A worker without rows for ``idle`` is forgotten.
    """

    def __init__(self, worker: str, limit: int, idle_ms: int):
        self.worker, self.limit, self.idle_ms = worker, limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, failed boolean")
        self.standing = handle.getValueState("standing", "streak int, timer long, idle boolean")

    def _wait_until(self, streak: int, timer: int, ms: int, idle: bool = False) -> None:
        if timer != ms:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)
        self.standing.update((streak, ms, idle))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            if len(frame):
                new = list(zip(frame["us"].tolist(), frame["failed"].tolist()))
                self.waiting.appendList(new)
                first = min(us for us, _ in new) // 1000
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            streak, timer, idle = 0, -1, True
            if self.standing.exists():
                streak, timer, idle = self.standing.get()
            self._wait_until(streak, timer, earliest if idle else min(earliest, timer))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        streak = self.standing.get()[0] if self.standing.exists() else 0
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] // 1000 <= mark]
        left = rows[len(due):]
        if not rows:                       # the idle timer
            self.standing.clear()
            return
        alerts = []
        for us, failed in due:
            streak = streak + 1 if failed else 0
            if streak == self.limit:
                alerts.append(us)
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        following = left[0][0] // 1000 if left else due[-1][0] // 1000 + self.idle_ms
        self._wait_until(streak, -1, max(following, mark + 1), not left)
        if alerts:
            yield pd.DataFrame({self.worker: [key[0]] * len(alerts), "alert_at": pd.to_datetime(alerts, unit="us")})

    def close(self) -> None:
        pass


def error_streaks(events: DataFrame, worker: str, ts: str, failed: Column, limit: int = 3,
                  delay: str = "1 hour", idle_seconds: int = 30 * 86_400) -> DataFrame:
    """(worker, alert_at): an alert each time a worker reaches ``limit`` errors in a row.

    Rows count in order of their time once the watermark, ``delay`` behind the
    newest row, has passed them; later ones are dropped. Equal times count a
    success before an error. State is the rows of the last ``delay`` and one
    streak per worker that was seen within ``idle_seconds``.
    """
    kind = dict(events.dtypes)[worker]
    rows = events.withWatermark(ts, delay).select(
        worker, F.col(ts).alias("_event_time"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), failed.alias("failed"))
    return rows.groupBy(worker).transformWithStateInPandas(
        _Streaks(worker, limit, idle_seconds * 1000), f"{worker} {kind}, alert_at timestamp", "append", "EventTime")
