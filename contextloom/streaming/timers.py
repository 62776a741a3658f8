"""Streams whose state has a life of its own: rate limits that forget silent clients, and feeds with heartbeats.

Both are stateful processors with lists, values and timers, which need the RocksDB state store (``use_timers``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contextloom.operators.tasks import TERMINAL
from contextloom.session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timers(spark: SparkSession) -> None:
    """Settings that these streams need; queries that run already keep theirs."""
    ship(spark)
    spark.conf.set(PROVIDER, ROCKS)


class Limiter(StatefulProcessor):
    """The sliding log of a client: the times of the requests that passed within the window."""

    def __init__(self, limit: int, micros: int):
        self.limit, self.micros = limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.log = handle, handle.getListState("log", "t long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        log = [t for (t,) in self.log.get()] if self.log.exists() else []
        batch, out = pd.concat(list(rows)), []  # a key's rows may come in parts
        for t, i in sorted(zip(batch["t"].tolist(), batch["event_id"].tolist(), strict=True)):
            log = [x for x in log if x > t - self.micros]
            ok = len(log) < self.limit
            if ok:
                log.append(t)
            out.append((key[0], i, ok))
        self.log.put([(t,) for t in log])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if log:
            self.handle.registerTimer((log[-1] + self.micros) // 1000 + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.log.clear()  # the watermark is past the window of the last request
        return iter([])

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, limit: int = 100, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """The sliding log of ``limits.rate_decisions`` on a stream (user_id, event_id, ts): (user_id, event_id, allowed).

    A client's state is the times of at most ``limit`` requests. It goes when the watermark, ``late`` behind the latest request
    of all, is a whole window past the client's last one: no request that may still come can be within it, however long the
    window is. Requests later than that are dropped.
    """
    use_timers(requests.sparkSession)
    rows = requests.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("t")).groupBy("user_id")
    return rows.transformWithStateInPandas(Limiter(limit, int(seconds * 1e6)), "user_id long, event_id long, allowed boolean", "Append", "EventTime")


class Feed(StatefulProcessor):
    """What a subscriber of a task hears: its state, each change, a sign of life when nothing happens, and the end."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.now = handle, handle.getValueState("now", "status string, ended boolean, told boolean")

    def again(self, at: int) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        self.now.update((initialState["status"].iloc[0], False, False))
        self.again(timerValues.getCurrentProcessingTimeInMs() + 1)

    def told(self, key: Any, *said: tuple[str, str | None]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], kind, status) for kind, status in said], columns=["task_id", "kind", "status"])

    def first(self, status: str) -> list[tuple[str, str | None]]:
        return [("snapshot", status)] + ([("end", status)] if status in TERMINAL else [])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, ended, known = self.now.get() if self.now.exists() else (None, False, False)
        said: list[tuple[str, str | None]] = []
        if status is not None and not known:  # updates came before the timer
            said += self.first(status)
            ended = status in TERMINAL
        for new in pd.concat(list(rows)).sort_values(["at", "event"])["event"]:
            if not ended:
                status, ended = new, new in TERMINAL
                said += [("update", new)] + ([("end", new)] if ended else [])
        self.now.update((status, ended, True))
        if ended:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        else:
            self.again(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        if said:
            yield self.told(key, *said)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, ended, known = self.now.get()
        said = [("heartbeat", status)] if known else self.first(status)
        ended = ended or said[-1][0] == "end"
        self.now.update((status, ended, True))
        if not ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        yield self.told(key, *said)

    def close(self) -> None:
        pass


def task_feed(updates: DataFrame, states: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Feeds of tasks as a stream (task_id, kind, status): from updates (task_id, at, event) and the states (task_id, status) now.

    Each task of ``states`` is heard of at once (snapshot), each update when it comes, then after every ``seconds`` without one a
    heartbeat; a completed, failed or cancelled task ends, and nothing follows. A task that only updates know has no snapshot.
    """
    use_timers(updates.sparkSession)
    rows = updates.select("task_id", "at", "event").groupBy("task_id")
    return rows.transformWithStateInPandas(Feed(int(seconds * 1000)), "task_id long, kind string, status string", "Append", "ProcessingTime", states.select("task_id", "status").groupBy("task_id"))
