"""Streams with timers."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from contextloom.operators import limits as L
from contextloom.streaming import timers as S


def test_limits_of_long_windows_on_a_stream(spark, tmp_path):
    """Windows over an hour, clients that are silent for hours, a file a batch: the same as at once."""
    r = np.random.default_rng(6)
    times = np.sort(r.integers(0, 36 * 3600, 400))
    rows = [(int(u), int(t), i) for i, (t, u) in enumerate(zip(times, r.integers(0, 6, 400), strict=True))]
    schema = "user_id long, t long, event_id long"
    at = F.timestamp_seconds("t").alias("ts")
    for k in range(8):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).select("user_id", at, "event_id").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        time.sleep(0.02)
    stream = spark.readStream.schema("user_id long, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = S.rate_limited(stream, 5, 2.5 * 3600).writeStream.format("memory").queryName("long_limits").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {x.event_id: x.allowed for x in spark.table("long_limits").collect()}
    model = L.rate_decisions(spark.createDataFrame(rows, schema).select("user_id", at, "event_id"), "user_id", "ts", "event_id", 5, 2.5 * 3600)
    assert got == {x.request_id: x.allowed for x in model.collect()} and not all(got.values())
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else 0
    assert left <= 6 * 8  # what windows hold, not the whole log


def test_a_feed_tells_state_changes_signs_of_life_and_the_end(spark, tmp_path):
    states = spark.createDataFrame([(1, "queued"), (2, "completed"), (3, "running")], "task_id long, status string")
    updates = lambda *rows: spark.createDataFrame(rows, "task_id long, at long, event string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    updates((4, 1, "queued"))
    stream = spark.readStream.schema("task_id long, at long, event string").parquet(str(tmp_path / "in"))
    query = S.task_feed(stream, states, 1.0).writeStream.format("memory").queryName("task_feed").outputMode("append").trigger(processingTime="200 milliseconds").start()

    def heard(i):
        return [(x.kind, x.status) for x in spark.table("task_feed").collect() if x.task_id == i]

    def until(what, seconds=120):
        end = time.time() + seconds
        while not what():
            assert time.time() < end and query.isActive, (query.exception(), spark.table("task_feed").collect())
            time.sleep(0.3)

    try:
        until(lambda: heard(1) and ("heartbeat", "running") in heard(3) and heard(2) and heard(4))
        updates((1, 2, "running"), (3, 2, "running"))
        until(lambda: ("update", "running") in heard(1))
        until(lambda: ("heartbeat", "running") in heard(1))
        updates((1, 3, "completed"), (1, 4, "running"))
        until(lambda: ("end", "completed") in heard(1))
        updates((1, 5, "failed"), (5, 1, "cancelled"))
        until(lambda: len(heard(5)) == 2)
    finally:
        query.stop()
    one = heard(1)
    assert one[0] == ("snapshot", "queued") and one[-2:] == [("update", "completed"), ("end", "completed")]
    assert [k for i, k in enumerate(one) if i == 0 or one[i - 1] != k][:1] == [("snapshot", "queued")] and one.index(("update", "running")) < one.index(("heartbeat", "running"))
    assert heard(2) == [("snapshot", "completed"), ("end", "completed")] and heard(4)[0] == ("update", "queued") and heard(5) == [("update", "cancelled"), ("end", "cancelled")]
