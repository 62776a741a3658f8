"""Maps that grow by updates: metadata of agents, and a map of bounded size that forgets its oldest."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_maps(updates: DataFrame, key: str, at: str, map_column: str, tie: str | None = None) -> DataFrame:
    """(key, map): all entries of a key's maps, of each entry the value of the last update that had it.

    Entries are combined by key and name before they shuffle, so a key with a third of all updates leaves each task as a row for
    each of its names. At equal times the larger ``tie`` counts, else the larger value. A null value is a value; null maps and
    empty ones say nothing, but their key is there. Entries come in the order of their names.
    """
    latest = F.struct(F.col(at), *([F.col(tie)] if tie else []))
    entries = updates.select(F.col(key), latest.alias("_at"), F.explode_outer(map_column).alias("_name", "_value"))
    # a struct around the value, as an aggregate passes over null values
    last = entries.groupBy(key, "_name").agg(F.max_by(F.struct("_value"), F.struct("_at", "_value")).alias("_last"))
    named = F.when(F.col("_name").isNotNull(), F.struct(F.col("_name").alias("key"), F.col("_last._value").alias("value")))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(named))).alias(map_column))  # a row for each name


def merged(old: Column, new: Column) -> Column:
    """A map with the entries of another in place of its own; null is an empty map."""
    kept = F.map_filter(old, lambda name, _: ~F.array_contains(F.map_keys(new), name))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def bounded(log: DataFrame, owner: str, order: str, entry: str, starts: Column, size: int) -> DataFrame:
    """(owner, order, evicted, held) of each row of a log of starts and ends (``starts`` false) of entries.

    An owner's map holds at most ``size`` entries: a new one beyond that evicts the one that began first; an entry that begins again
    stays where it is; the end of an entry that isn't there changes nothing. What is evicted depends on all rows before, so
    an owner's rows stream through one task in order, with ``size`` entries as its state. Rows without an order come first, by
    entry; null is an owner and an entry like any other.
    """
    rows = log.select(F.col(owner).alias("owner"), F.col(order).alias("order"), F.col(entry).alias("entry"), F.coalesce(starts, F.lit(False)).alias("starts"))
    ready = rows.repartition("owner").sortWithinPartitions("owner", "order", "entry", "starts")
    kinds = dict(rows.dtypes)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: OrderedDict[object, None] = OrderedDict()
        who: object = fold
        for batch in batches:
            evicted: list[object] = []
            held: list[int] = []
            for o, e, begins in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if o != who:
                    who = o
                    now.clear()
                gone = None
                if not begins:
                    now.pop(e, None)
                elif e not in now:
                    if len(now) >= size:
                        gone = now.popitem(last=False)[0]
                    now[e] = None
                evicted.append(gone)
                held.append(len(now))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(evicted, batch.column(2).type), pa.array(held, pa.int32())], names=[owner, order, "evicted", "held"])

    return ready.mapInArrow(fold, f"`{owner}` {kinds['owner']}, `{order}` {kinds['order']}, evicted {kinds['entry']}, held int")
