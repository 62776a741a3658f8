"""Event streams: windows, sessions, agent health and task states as Structured Streaming; ``timers`` has those that need timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The ``events`` table as a stream. Watermarks need a timestamp with zone."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum by window and type; batch frames ignore the watermark."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def task_states(events: DataFrame) -> DataFrame:
    """States of tasks from a stream of (task_id, at, event): (task_id, status, illegal) whenever a task changes.

    As in ``tasks.final_states``: cancelling a finished task is illegal and changes nothing, completing overwrites. The
    state of a task is its status, whether it ever finished, and its illegal events.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        status, finished, illegal = state.get if state.exists else (None, False, 0)
        for event in pd.concat(list(batches)).sort_values(["at", "event"])["event"]:  # a key's rows may come in parts
            if event == "cancelled" and finished:
                illegal += 1
                continue
            status, finished = event, finished or event in ("completed", "failed")
        state.update((status, finished, illegal))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "illegal": [illegal]})

    rows = events.select("task_id", "at", "event").groupBy("task_id")
    return rows.applyInPandasWithState(follow, "task_id long, status string, illegal long", "status string, finished boolean, illegal long", "update", "NoTimeout")


def agent_health(heartbeats: DataFrame, silence: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Spells of an agent without a silence longer than ``silence``; a spell's end is when it turned unhealthy."""
    rows = heartbeats.withWatermark("ts", late).groupBy(F.session_window("ts", silence).alias("s"), "agent_id").agg(F.count(F.lit(1)).alias("beats"))
    return rows.select("agent_id", F.col("s.start").alias("online_from"), F.col("s.end").alias("unhealthy_at"), "beats")


def feed(updates: DataFrame, snapshot: Callable[[DataFrame, int], None], every: str = "5 seconds", checkpoint: str | None = None) -> Any:
    """A subscription: ``snapshot(batch, number)`` gets each batch of updates; the stream's checkpoint makes it resume."""
    writer = updates.writeStream.foreachBatch(snapshot).trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


class Callbacks:
    """What to call when a task ends: each once, on the driver, and an error in one hurts no other.

    A stream of states (task_id, status, ...) is heard with ``feed(states, callbacks.deliver)``. Only rows of tasks that
    someone waits for come to the driver.
    """

    def __init__(self, terminal: Sequence[str] = ("completed", "failed", "cancelled")):
        self.terminal, self.waiting, self.errors = tuple(terminal), {}, []  # type: ignore[var-annotated]

    def add(self, task_id: int, callback: Callable[[Row], None]) -> None:
        self.waiting.setdefault(task_id, []).append(callback)

    def deliver(self, states: DataFrame, number: int = 0) -> None:
        if not self.waiting:
            return
        asked = states.sparkSession.createDataFrame([(i,) for i in self.waiting], "task_id long")
        ended = states.where(F.col("status").isin(*self.terminal)).join(F.broadcast(asked), "task_id")
        for row in ended.collect():  # at most a row for each task and state that is waited for
            for callback in self.waiting.pop(row.task_id, ()):
                try:
                    callback(row)
                except Exception as e:  # a callback may fail in any way
                    self.errors.append((row.task_id, e))
