"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token ids and an end id; what is longer than a sequence is cut into full pieces and a shorter first one.
Full pieces are sequences of their own. The others are dealt at random into blocks of about ``block_items`` pieces, so
no task's work depends on any key. Each block lives on ``islands``: an island keeps a few whole packings of the block
and breeds them. One founder is packed by best fit decreasing, so no block ever takes more bins than that gives; the others
by best fit in orders that chance blurs differently, so that they differ and there is something to breed. A crossover takes well-filled bins of one parent over into the other as they are, removes the bins
there that hold one of their pieces (the duplicates), and puts the displaced pieces back by best fit, largest first.
After each epoch the best packing of an island migrates to the next one. Bins of a block's best packing that stayed
under ``least_fill`` are opened, and their pieces from all blocks are dealt and bred once more, so that no block keeps
a half-empty bin.

Each step writes its islands to the shared folder, so a lost executor costs one step of some blocks.

A file of ranks holds no added tokens, such as the literal of an end of text. Where a tokenizers file has them,
``added_tokens`` reads them, and ``added`` takes them: each becomes its one id, as in a default call of tokenizers.
Without ``added`` such literals are text like any other.

Defined cases: null text counts as empty and gives one piece, the end id alone; repeated rows and ids give pieces
once for each row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contextloom.llm.common import cut, release, scratch, ship
from contextloom.llm.secret_scan import encoder

Bins = list[tuple[int, ...]]  # of item numbers
BLUR = 0.9


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity if n is larger."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def added_tokens(path: str) -> dict[str, int]:
    """Literals and ids of the added tokens of a tokenizers file; those that match other than literally are refused."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    odd = [t["content"] for t in found if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"added tokens that take in or need their surroundings: {odd}")
    return {t["content"]: t["id"] for t in found}


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id",
           added: Mapping[str, int] | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    specials = tuple(sorted((added or {}).items()))
    ship(docs.sparkSession)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern, specials)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((enc.encode_to_numpy(t, allowed_special="all") if t else end[:0], end)).astype("<u4")
                raw = memoryview(ids.tobytes())
                rows += [(d, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            d, k, s, n, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(tokenise, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], order: list[int], bins: Bins, fills: list[int], capacity: int) -> tuple[Bins, list[int]]:
    """Put the pieces of ``order`` one after the other into the fullest bin that has room, or a new one."""
    open_bins = [list(b) for b in bins]
    fills = list(fills)
    room = sorted((capacity - f, k) for k, f in enumerate(fills) if f < capacity)
    for i in order:
        n = lengths[i]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, k = room.pop(at)
            open_bins[k].append(i)
            fills[k] += n
        else:
            k, free = len(open_bins), capacity
            open_bins.append([i])
            fills.append(n)
        if free > n:
            insort(room, (free - n, k))
    return [tuple(b) for b in open_bins], fills


class Island:
    """Packings of one block, best first."""

    def __init__(self, lengths: list[int], capacity: int, seed: int, size: int):
        self.lengths, self.capacity, self.size = lengths, capacity, size
        self.chance = random.Random(seed)
        self.members: list[tuple[float, Bins, list[int]]] = []
        self.least = -(-sum(lengths) // capacity)

    def add(self, bins: Bins, fills: list[int]) -> None:
        """Fewer bins are better; of as many, those of uneven fill, as full and nearly empty bins breed well."""
        score = len(bins) - sum((f / self.capacity) ** 2 for f in fills) / max(1, len(bins))
        self.members.append((score, bins, fills))
        self.members.sort(key=lambda m: m[0])
        del self.members[self.size :]

    def add_groups(self, bin_of: list[int]) -> None:
        found: dict[int, list[int]] = {}
        for i, k in enumerate(bin_of):
            found.setdefault(k, []).append(i)
        bins = [tuple(b) for b in found.values()]
        self.add(bins, [sum(self.lengths[i] for i in b) for b in bins])

    def settle(self) -> None:
        """Founders: best fit in orders of length that chance blurs, some more and some less."""
        for _ in range(self.size - 1):
            blur = [n * (1 + self.chance.uniform(-BLUR, BLUR)) for n in self.lengths]
            order = sorted(range(len(blur)), key=blur.__getitem__, reverse=True)
            self.add(*best_fit(self.lengths, order, [], [], self.capacity))

    def decreasing(self) -> int:
        """One more founder, by best fit decreasing; its bins."""
        order = sorted(range(len(self.lengths)), key=self.lengths.__getitem__, reverse=True)
        found = best_fit(self.lengths, order, [], [], self.capacity)
        self.add(*found)
        return len(found[0])

    def cross(self, giver: tuple[float, Bins, list[int]], taker: tuple[float, Bins, list[int]]) -> None:
        _, bins, fills = giver
        full = [k for k, f in enumerate(fills) if f >= 0.99 * self.capacity]
        if not full:
            full = sorted(range(len(fills)), key=fills.__getitem__, reverse=True)[: max(1, len(fills) // 4)]
        taken = [bins[k] for k in self.chance.sample(full, max(1, len(full) // 4))]
        inside = {i for b in taken for i in b}
        keep: Bins = []
        kept_fills: list[int] = []
        displaced: list[int] = []
        weak = 0.9 * self.capacity
        for b, f in zip(taker[1], taker[2], strict=True):
            if not inside.isdisjoint(b) or f < weak:
                displaced += [i for i in b if i not in inside]
            else:
                keep.append(b)
                kept_fills.append(f)
        keep += taken
        kept_fills += [sum(self.lengths[i] for i in b) for b in taken]
        displaced.sort(key=self.lengths.__getitem__, reverse=True)
        self.add(*best_fit(self.lengths, displaced, keep, kept_fills, self.capacity))

    def evolve(self, crossings: int) -> None:
        for _ in range(crossings):
            if len(self.members) < 2 or len(self.members[0][1]) <= self.least:
                return  # nothing can be better
            giver, taker = self.chance.sample(self.members, 2)
            self.cross(giver, taker)

    def groups(self, member: int = 0) -> list[int]:
        out = [0] * len(self.lengths)
        for k, b in enumerate(self.members[member][1]):
            for i in b:
                out[i] = k
        return out


ISLAND = "block long, island int, lengths array<int>, packings array<array<int>>, score double, founded int, best_fit int, bins int"


def _live(batches: Iterator[pa.RecordBatch], capacity: int, members: int, crossings: int, epoch: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            home = Island(row["lengths"], capacity, row["block"] * 1009 + row["island"] * 31 + epoch, members)
            founded, best = row["founded"], row["best_fit"]
            if epoch == 0:
                home.settle()
                founded = len(home.members[0][1]) if home.members else 0
                best = home.decreasing()
            for g in row["packings"] or ():
                home.add_groups(g)
            home.evolve(crossings)
            kept = [home.groups(k) for k in range(len(home.members))]
            schema = [pa.array([row["block"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([row["lengths"]], pa.list_(pa.int32())), pa.array([kept], pa.list_(pa.list_(pa.int32()))), pa.array([home.members[0][0]], pa.float64())]
            schema += [pa.array([n], pa.int32()) for n in (founded, best, len(home.members[0][1]))]
            yield pa.RecordBatch.from_arrays(schema, names=["block", "island", "lengths", "packings", "score", "founded", "best_fit", "bins"])


def dealt_blocks(items: DataFrame, n_items: int, block_items: int) -> DataFrame:
    """(block, items): the pieces, dealt at random into blocks of about ``block_items``. Written."""
    blocks = max(1, round(n_items / block_items))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long")
    fields = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    return cut(items.withColumn("block", place).groupBy("block").agg(F.collect_list(fields).alias("items")))


def bred(dealt: DataFrame, n_items: int, capacity: int, block_items: int, islands: int, epochs: int, members: int, crossings: int) -> DataFrame:
    """The islands of the blocks after all epochs, with their packings, the bins of the best founder and of the best now."""
    live = functools.partial(_live, capacity=capacity, members=members, crossings=crossings)
    world = dealt.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.transform("items", lambda x: x["length"].cast("int")).alias("lengths"),
        F.expr("cast(null as array<array<int>>)").alias("packings"), F.lit(0.0).alias("score"), F.lit(0).alias("founded"), F.lit(0).alias("best_fit"), F.lit(0).alias("bins"),
    )
    spread = min(max(1, round(n_items / block_items)) * islands, 2000)
    world = cut(world.repartition(spread, "block", "island").mapInArrow(functools.partial(live, epoch=0), ISLAND))
    for epoch in range(1, epochs):
        guests = world.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.slice("packings", 1, 1).alias("guest"))
        met = world.join(guests, ["block", "island"]).select("block", "island", "lengths", F.concat("packings", "guest").alias("packings"), "score", "founded", "best_fit", "bins")
        old, world = world, cut(met.mapInArrow(functools.partial(live, epoch=epoch), ISLAND))
        release(old)
    return world


def pack_round(items: DataFrame, n_items: int, capacity: int, block_items: int, islands: int, epochs: int, members: int, crossings: int) -> DataFrame:
    """``items`` (columns of pieces) with block and bin."""
    dealt = dealt_blocks(items, n_items, block_items)
    world = bred(dealt, n_items, capacity, block_items, islands, epochs, members, crossings)
    best = world.groupBy("block").agg(F.min_by(F.get("packings", F.lit(0)), F.struct("score", "island")).alias("bins"))
    sides = dealt.join(best, "block").select("block", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    return sides.select("block", "x.items.*", F.col("x.bins").alias("bin"))


def evolution(cuts_: DataFrame, capacity: int = 2048, block_items: int = 4000, islands: int = 2, epochs: int = 2, members: int = 5, crossings: int = 24) -> DataFrame:
    """Per block of pieces (of ``pieces``): how many, the bins of its best blurred founder, of best fit decreasing, of its best packing, and the least possible."""
    items = cuts_.where(F.col("length") < capacity)
    n = items.count()
    world = bred(dealt_blocks(items, n, block_items), n, capacity, block_items, islands, epochs, members, crossings)
    least = F.ceil(F.aggregate(F.first("lengths"), F.lit(0).cast("long"), lambda a, x: a + x) / capacity)
    return world.groupBy("block").agg(F.first(F.size("lengths")).alias("pieces"), F.min("founded").alias("founded"), F.min("best_fit").alias("best_fit"), F.min("bins").alias("bins"), least.alias("least"))


def packed(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id",
           block_items: int = 4000, islands: int = 2, epochs: int = 2, members: int = 5, crossings: int = 24, least_fill: float = 0.97, added: Mapping[str, int] | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with scratch(docs.sparkSession) as made:
        out = cut(_packed(docs, vocabulary, pattern, capacity, end_id, text, doc_id, (capacity, block_items, islands, epochs, members, crossings), least_fill, added))
        made.keep(out)
    return out


def _packed(docs: DataFrame, vocabulary: str, pattern: str, capacity: int, end_id: int, text: str, doc_id: str, options: tuple, least_fill: float, added: Mapping[str, int] | None) -> DataFrame:
    cuts_ = cut(pieces(docs, vocabulary, pattern, capacity, end_id, text, doc_id, added))
    full = cuts_.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = cuts_.where(F.col("length") < capacity)
    first = cut(pack_round(items, items.count(), *options))
    fills = first.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    first = cut(first.join(fills, ["block", "bin"]))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    weak = first.where(F.col("fill") < least_fill * capacity).select(columns)
    second = cut(pack_round(weak, weak.count(), *options))
    number = lambda stage: (F.col("block") * 2 + stage) * (1 << 24) + F.col("bin")
    rows = first.where(F.col("fill") >= least_fill * capacity).select(*columns, number(0).alias("sequence_id"))
    rows = rows.unionByName(second.select(*columns, number(1).alias("sequence_id")))
    return full.unionByName(with_offsets(rows))


def with_offsets(rows: DataFrame) -> DataFrame:
    """A sequence has at most as many pieces as tokens, so its window is bounded."""
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "start").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
