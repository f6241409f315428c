"""State that ends: a timer closes a key that has been idle, a time to live forgets what is remembered about it."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from .windows import _events

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "user_id long, start timestamp, last timestamp, n long, cents long"


class IdleCloser(StatefulProcessor):
    """Sums a user's events until none has come for a gap of event time; then writes them and forgets them.

    State is one row for an open stretch and one timer, so it is bounded by the users who are active within a gap of the
    watermark.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, last long, n long, cents long")

    @staticmethod
    def _rows(key: tuple, stretches: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *s) for s in stretches], columns=["user_id", "start", "last", "n", "cents"])
        return frame.assign(start=pd.to_datetime(frame["start"], unit="us"), last=pd.to_datetime(frame["last"], unit="us"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values("us")
        now, done = (tuple(self.open.get()) if self.open.exists() else None), []
        for us, cents in zip(arrived["us"].tolist(), arrived["cents"].tolist()):
            if now and us - now[1] >= self.gap_ms * 1000:
                done.append(now)
                now = None
            now = (us, us, 1, cents) if now is None else (min(now[0], us), max(now[1], us), now[2] + 1, now[3] + cents)
        self.open.update(now)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now[1] // 1000 + self.gap_ms)
        if done:
            yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            now = tuple(self.open.get())
            self.open.clear()
            yield self._rows(key, [now])

    def close(self) -> None:
        pass


class FirstSeen(StatefulProcessor):
    """Lets the first event of a key through, and others only once the key has been forgotten: a time to live after it."""

    def __init__(self, remember_ms: int):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "event_id long", self.remember_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        if not self.seen.exists():
            first = int(arrived["event_id"].min())
            self.seen.update((first,))
            yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "event_id": [first]})

    def close(self) -> None:
        pass


@contextmanager
def rocks_db(spark: SparkSession, without_data: bool = True):
    """The state store that timers and times to live need, for queries that run within. Queries by processing time always
    ask for one more batch, so one that is to end with its input must not run batches without data."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": str(without_data).lower()}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _sent_whole(stream: DataFrame) -> None:
    """The driver's own worker, which calls init, has no path to shipped packages: these classes go with the query."""
    ship(stream.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def idle_closed(stream: DataFrame, gap_ms: int) -> DataFrame:
    """user_id, start, last, n, cents of each stretch of events, written once the watermark has passed its end by the gap."""
    _sent_whole(stream)
    events = _events(stream).selectExpr("user_id", "ts", "unix_micros(ts) AS us", "cents")
    return events.groupBy("user_id").transformWithStateInPandas(IdleCloser(gap_ms), CLOSED, "Append", "EventTime")


def first_seen(stream: DataFrame, remember_ms: int) -> DataFrame:
    """user_id, event_type, event_id: an event of each such pair, and none other for so long (of processing time)."""
    _sent_whole(stream)
    events = stream.select("user_id", "event_type", "event_id")
    return events.groupBy("user_id", "event_type").transformWithStateInPandas(FirstSeen(remember_ms), "user_id long, event_type string, event_id long", "Append", "ProcessingTime")
