"""What depends on the rows before it, key by key in order of time, without giving a key to one task.

Rows are range-partitioned by key and time and sorted, and one pass over each partition, in the same stage, carries what
it needs from row to row; what it can't know is what earlier partitions hold of its first key. A partition therefore also says how
its last key stood at its end. These ends, a row for each partition, are joined to the partitions that go on with the same
key, and complete their first rows. So a key with a third of all rows spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from contextloom.storage import cut

ROW, FIRST, END = 0, 1, 2  # kinds of rows that a pass gives


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def starts_of(keys: pa.Array, before: object) -> np.ndarray:
    """Whether each row's key differs from that of the row before; ``before`` is the last one of the batch before (or the class object)."""
    n = len(keys)
    if not n:
        return np.zeros(0, bool)
    same = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
    both_null = pc.and_(pc.is_null(keys[1:]), pc.is_null(keys[:-1])).to_numpy(zero_copy_only=False)
    return np.r_[before is object or keys[0].as_py() != before, ~(same | both_null)]


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, columns: Sequence[str], hours: float | None = None) -> DataFrame:
    """``left`` with the ``columns`` of the last row of ``right`` that has its key and isn't later; null if there is none.

    Both sides have ``key``. Of right rows with equal key and time the one with the largest columns counts. With ``hours`` a row
    that is that old or older doesn't count, as if it had been deleted when it expired. Rows of ``left`` without key or time find
    nothing, and rows of ``right`` without either are found by nobody. Names of ``columns`` must not be among those of ``left``.
    """
    if taken := [c for c in columns if c in left.columns]:
        raise ValueError(f"columns that the left side has too: {taken}")
    kept, found = F.struct(*left.columns), F.struct(*columns)
    none = lambda c, df: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    asked = left.select(F.col(key).alias("key"), micros(F.col(left_at)).alias("at"), F.lit(1).alias("side"), none(found, right).alias("found"), kept.alias("row"))
    given = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(F.col(key).alias("key"), micros(F.col(right_at)).alias("at"), F.lit(0).alias("side"), found.alias("found"), none(kept, left).alias("row"))
    rows = asked.unionByName(given).withColumn("chance", F.monotonically_increasing_id())
    order = ("key", "at", "side", "found", "chance")
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), rows.schema["key"], T.StructField("at", T.LongType()),
        T.StructField("open", T.BooleanType()), T.StructField("found_at", T.LongType()), rows.schema["found"], rows.schema["row"],
    ])

    arrow = to_arrow_schema(schema)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()  # type: ignore[union-attr]
        last: object = object
        held: pa.Array | None = None  # the last right row of the key so far: one element
        held_at: int | None = None
        first = True  # still at the partition's first key
        for batch in batches:
            if not len(batch):
                continue
            keys, at, side, given_, row = (batch.column(batch.schema.names.index(c)) for c in ("key", "at", "side", "found", "row"))
            if last is object:
                yield made(FIRST, part, keys[:1], None, None, given_.slice(0, 1), row.slice(0, 1))
            new = starts_of(keys, last)
            place = np.arange(len(keys))
            begun = np.maximum.accumulate(np.where(new, place, -1))  # where the row's key begins; -1: in an earlier batch
            wrote = np.maximum.accumulate(np.where(side.to_numpy() == 0, place, -1))
            local = wrote >= np.maximum(begun, 0)
            ask = side.to_numpy() == 1
            carried = (begun < 0) & ~local & (held is not None)
            in_first = (np.cumsum(new) - (1 if last is object else 0) == 0) & first
            pool = pa.concat_arrays([given_, held if held is not None else given_.slice(0, 1)])
            times = pa.concat_arrays([at, pa.array([held_at], pa.int64())])
            take = np.where(local, wrote, np.where(carried, len(keys), -1))
            index = pa.array(take[ask], mask=take[ask] < 0)
            which = pa.array(place[ask])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(which), ROW, np.int32)), pa.array(np.full(len(which), part, np.int32)), keys.take(which), at.take(which),
                pa.array(((take < 0) & in_first)[ask]), times.take(index), pool.take(index), row.take(which),
            ], schema=arrow)
            end = take[-1]
            held, held_at = (None, None) if end < 0 else (pool.take(pa.array([end])), times[int(end)].as_py())
            first = bool(in_first[-1])
            last = keys[-1].as_py()
            tail = keys.slice(len(keys) - 1), given_.slice(0, 1), row.slice(0, 1)
        if last is not object:
            yield made(END, part, tail[0], first, held_at, held if held is not None else tail[1], tail[2], held is None)

    def made(kind: int, part: int, key_: pa.Array, open_: bool | None, at_: int | None, found_: pa.Array, row_: pa.Array, empty: bool = True) -> pa.RecordBatch:
        null = pa.array([None], pa.int64())
        nothing = lambda a: a.take(pa.array([None], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), key_, null, pa.array([open_], pa.bool_()), pa.array([at_], pa.int64()), nothing(found_) if empty else found_, nothing(row_)], schema=arrow)

    swept = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sweep, schema))
    ends = swept.where(F.col("kind") == END).select("part", "key", F.lit(1).alias("place"), F.when(F.col("found_at").isNotNull(), F.struct("found_at", "found")).alias("end"))
    firsts = swept.where(F.col("kind") == FIRST).select("part", "key", F.lit(0).alias("place"), F.lit(None).cast(ends.schema["end"].dataType).alias("end"))
    before = Window.partitionBy("key").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.unionByName(firsts).withColumn("before", F.last("end", ignorenulls=True).over(before)).where("place = 0 and before is not null").select("part", "before")  # a row for each partition at most
    out = swept.where(F.col("kind") == ROW).join(F.broadcast(carry), "part", "left")
    late = F.col("open") & F.col("key").isNotNull()
    found_at = F.when(late, F.col("before.found_at")).otherwise(F.col("found_at"))
    got = F.when(late, F.col("before.found")).otherwise(F.col("found"))
    fits = found_at.isNotNull() & F.col("at").isNotNull()
    if hours is not None:
        fits = fits & (F.col("at") - found_at < int(hours * 3_600_000_000))
    return out.select("row", F.when(fits, got).alias("found")).select("row.*", "found.*")
