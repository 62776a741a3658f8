"""Rate limits: sliding log per client, spacing per domain, requests by time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from contextloom.operators.asof import END, FIRST, ROW, starts_of
from contextloom.storage import cut


def rate_decisions(requests: DataFrame, client: str = "client", at: str = "at", key: str = "request_id", limit: int = 100, seconds: float = 60.0) -> DataFrame:
    """(client, request_id, allowed) of a sliding log: a request passes if fewer than ``limit`` passed in the last ``seconds``.

    Refused requests are not recorded, so each decision depends on those before; rows of a client come sorted in one
    partition and stream through a log of at most ``limit`` times.
    """
    rows = requests.select(F.col(client).cast("long").alias("client"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(key).cast("long").alias("request_id"))
    ready = rows.where("at is not null").repartition("client").sortWithinPartitions("client", "at", "request_id")
    window = int(seconds * 1e6)

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log: deque[int] = deque()
        who: object = decide
        for batch in batches:
            allowed = []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != who:
                    who = c
                    log.clear()
                while log and log[0] <= t - window:
                    log.popleft()
                allowed.append(len(log) < limit)
                if allowed[-1]:
                    log.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(allowed, pa.bool_())], names=["client", "request_id", "allowed"])

    return ready.mapInArrow(decide, "client long, request_id long, allowed boolean")


def spaced(requests: DataFrame, domain: str, at: str, key: str, seconds: float = 1.0) -> DataFrame:
    """When each request may go: at least ``seconds`` after the one before on its domain.

    The recurrence s[i] = max(t[i], s[i-1] + d) is a running maximum of t[i] - i*d, plus i*d. One pass over range partitions sorted
    by domain and time numbers the requests of each domain and carries the maximum; a partition that goes on with a domain
    needs only the number of that domain's requests before it and the maximum so far (as in ``asof``, a row for each partition).
    So a domain with a third of all requests spreads over many tasks.
    """
    d = int(seconds * 1e6)
    rows = requests.select(F.col(domain).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(key).alias("tie"), F.struct(*requests.columns).alias("row"))
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("key", rows.schema["key"].dataType), T.StructField("t", T.LongType()), T.StructField("open", T.BooleanType()),
        T.StructField("i", T.LongType()), T.StructField("most", T.LongType()), T.StructField("row", rows.schema["row"].dataType),
    ])
    arrow = to_arrow_schema(schema)

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()  # type: ignore[union-attr]
        last: object = object
        n, most, first = 0, None, True  # of the last key: requests so far and the maximum; still at the partition's first key

        def mark(kind: int, key_: pa.Array, row: pa.Array) -> pa.RecordBatch:
            none = row.take(pa.array([None], pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), key_, pa.array([None], pa.int64()), pa.array([first]), pa.array([n], pa.int64()), pa.array([most], pa.int64()), none], schema=arrow)

        for batch in batches:
            if not len(batch):
                continue
            keys, t, row = batch.column(0), batch.column(1), batch.column(3)
            if last is object:
                yield mark(FIRST, keys[:1], row[:1])
            new = starts_of(keys, last)
            place, segment = np.arange(len(keys)), np.cumsum(new)
            begun = np.maximum.accumulate(np.where(new, place, -1))
            i = np.where(begun < 0, place + n, place - begun)
            times = t.to_pandas()  # a null time has no wait and holds nobody up
            free = times - i * d
            if begun[0] < 0 and most is not None:
                free.iloc[0] = max(x for x in (free.iloc[0], most) if x == x)
            running = free.groupby(segment).cummax().groupby(segment).ffill()
            mine = (segment - (1 if last is object else 0) == 0) & first
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(keys), ROW, np.int32)), pa.array(np.full(len(keys), part, np.int32)), keys, t, pa.array(mine), pa.array(i, pa.int64()),
                pa.array(running.to_numpy(dtype="float64", na_value=np.nan), pa.float64(), from_pandas=True).cast(pa.int64()), row,
            ], schema=arrow)
            n, most = int(i[-1]) + 1, None if running.iloc[-1] != running.iloc[-1] else int(running.iloc[-1])
            first, last, tail = bool(mine[-1]), keys[-1].as_py(), (keys.slice(len(keys) - 1), row[:1])
        if last is not object:
            yield mark(END, *tail)

    order = ("key", "t", "tie")
    swept = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sweep, schema))
    edges = swept.where(F.col("kind") != ROW).select("part", "key", F.col("kind").alias("place"), F.when(F.col("kind") == END, F.col("i")).otherwise(0).alias("n"), F.when(F.col("kind") == END, F.col("most")).alias("top"))
    earlier = Window.partitionBy("key").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    edges = edges.withColumn("reached", F.max(F.col("top") - F.col("before") * d).over(earlier)).where(F.col("place") == FIRST).select("part", "before", "reached")
    met = swept.where(F.col("kind") == ROW).join(F.broadcast(edges), "part")  # a row for each partition
    before = F.when(F.col("open"), F.col("before")).otherwise(0)
    sent = F.greatest(F.when(F.col("open"), F.col("reached")), F.col("most") - before * d) + (F.col("i") + before) * d
    out = met.select("row", "t", sent.alias("sent"))
    return out.select("row.*", F.col("sent").alias("sent_micros"), (F.col("sent") - F.col("t")).alias("wait_micros"))


def request_rates(requests: DataFrame, client: str, at: str, seconds: int = 60) -> DataFrame:
    """For each request the number of the client's requests in the ``seconds`` up to it (refused ones included)."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(client).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w))
