"""Benchmark decontamination by a prefix-filtered set join.

An item is the list of its windows: ten consecutive words, or the whole item if it has fewer. A window is the set of
its shingles (five words, or the whole window if shorter). A first pass over all documents counts in how many of them
each item shingle occurs. Ordered by that rarity, containment of a whole window needs a prefix of one shingle: its
rarest. A second pass joins documents to windows on those prefix shingles, keeps starts that the window's length and
the shingle's place in it allow, and compares all of the window's words.

Words of the items are numbered, so a comparison of numbers is one of words: nothing rests on hashes alone. The
index of the items is sent to all executors; items come in blocks of at most ``block_words`` words, two passes for each,
so what is sent and what the driver holds have a bound however large the benchmark is. With more than one block, each
writes the hits it finds before the next one is made, under the documents' lasting numbers. Texts never shuffle.

Defined cases: null and wordless texts have n_words 0 and no hits; wordless items match nothing; an item without id
marks words but is not listed; items that share an id count once; repeated rows come out once each; empty tables give
empty results, or no hits; further columns are kept by ``decontaminate`` whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm.common import Rows, byte_lists, cut, free_name, release, ship, words_of

SHINGLE = 5
MIX = np.uint64(0x9E3779B97F4A7C15)


def rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` ids."""
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for i in range(size):
        out = (out + ids[i : i + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return out


@dataclass
class ItemBlock:
    """Windows of some items: word numbers, shingles, and what stands where."""

    vocabulary: dict[bytes, int]
    windows: dict[int, np.ndarray]  # by length: a row of word numbers for each distinct window
    owners: dict[int, list[list[str]]]  # by length: the ids of the items that have it
    shingles: dict[int, np.ndarray]  # by shingle size: sorted hashes
    prefix: dict[int, dict[int, list[tuple[int, int, int]]]]  # by shingle size and hash: (length, window, offset)

    def numbers(self, text: bytes | None) -> tuple[int, np.ndarray]:
        words = words_of(text)
        get = self.vocabulary.get
        return len(words), np.array([get(w, -1) for w in words], np.int64)

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, hashes) of the runs of item words that are item shingles."""
        gaps = np.concatenate(([0], np.cumsum(ids < 0)))
        for size, known in self.shingles.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(gaps[size:] == gaps[: len(gaps) - size])
            if len(at):
                h = rolled(ids.astype(np.uint64), size)[at]
                found = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                yield size, at[found], h[found]

    def occurring(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Places (start, end) of all windows in a document's words, and ids of their items."""
        spans: set[tuple[int, int]] = set()
        items: set[str] = set()
        for size, places, hashes in self.candidates(ids):
            prefix = self.prefix[size]
            for p, h in zip(places.tolist(), hashes.tolist(), strict=True):
                for length, window, offset in prefix.get(h, ()):
                    start = p - offset
                    if start < 0 or start + length > len(ids):
                        continue
                    if np.array_equal(ids[start : start + length], self.windows[length][window]):
                        spans.add((start, start + length))
                        items.update(self.owners[length][window])
        return sorted(spans), items


def index_items(items: list[tuple[str | None, bytes | None]], window: int) -> ItemBlock:
    vocabulary: dict[bytes, int] = {}
    owners: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item_id, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        length = min(window, len(ids))
        for i in range(len(ids) - length + 1 if ids else 0):
            owners.setdefault(length, {}).setdefault(tuple(ids[i : i + length]), set()).update([item_id] * (item_id is not None))
    windows = {n: np.array(list(of), np.int64) for n, of in owners.items()}
    found: dict[int, list[np.ndarray]] = {}
    for n, w in windows.items():
        size = min(SHINGLE, n)
        found.setdefault(size, []).extend(rolled(row.astype(np.uint64), size) for row in w)
    shingles = {size: np.unique(np.concatenate(h)) for size, h in found.items()}
    return ItemBlock(vocabulary, windows, {n: [sorted(x) for x in of.values()] for n, of in owners.items()}, shingles, {})


def set_prefixes(block: ItemBlock, rarity: dict[tuple[int, int], int]) -> None:
    """Give every window its rarest shingle; of equally rare ones the one with the smallest hash."""
    block.prefix = {size: {} for size in block.shingles}
    for n, windows in block.windows.items():
        size = min(SHINGLE, n)
        for k, row in enumerate(windows):
            h = rolled(row.astype(np.uint64), size).tolist()
            offset = min(range(len(h)), key=lambda i: (rarity.get((size, h[i]), 0), h[i], i))
            block.prefix[size].setdefault(h[offset], []).append((n, k, offset))


def count_rarity(docs: DataFrame, text: str, block: ItemBlock) -> dict[tuple[int, int], int]:
    """In how many documents each item shingle occurs, counted over all of them."""
    order = {size: {h: i for i, h in enumerate(known.tolist())} for size, known in block.shingles.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {size: np.zeros(len(known), np.int64) for size, known in block.shingles.items()}
        for batch in batches:
            for t in byte_lists(batch.column(0)):
                for size, _, hashes in block.candidates(block.numbers(t)[1]):
                    seen[size][[order[size][h] for h in set(hashes.tolist())]] += 1
        for size, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({"size": np.full(len(at), size, np.int32), "k": at.astype(np.int64), "n": n[at]})

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "size int, k long, n long")
    rows = counted.groupBy("size", "k").agg(F.sum("n").alias("n")).collect()  # at most the shingles of one block
    return {(r.size, int(block.shingles[r.size][r.k])): r.n for r in rows}


def item_blocks(items: DataFrame, text: str, item_id: str, window: int, block_words: int) -> Iterator[ItemBlock]:
    """The items by blocks of at most ``block_words`` words (a longer item is a block of its own)."""
    block: list[tuple[str | None, bytes | None]] = []
    n = 0
    for r in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        t = r.t.encode() if r.t is not None else None
        words = len(words_of(t))
        if block and n + words > block_words:
            yield index_items(block, window)
            block, n = [], 0
        if words:
            block.append((r.i, t))
            n += words
    if block:
        yield index_items(block, window)


def ready_blocks(docs: DataFrame, items: DataFrame, text: str, item_text: str, item_id: str, window: int, block_words: int) -> Iterator[ItemBlock]:
    ship(docs.sparkSession)
    for block in item_blocks(items, item_text, item_id, window, block_words):
        set_prefixes(block, count_rarity(docs, text, block))
        yield block


def one_or_more(blocks: Iterator[ItemBlock], window: int) -> tuple[ItemBlock | None, Iterator[ItemBlock]]:
    """The only block, or all of them one after the other."""
    first = next(blocks, None) or index_items([], window)
    second = next(blocks, None)
    return (first, blocks) if second is None else (None, itertools.chain(iter([first]), iter([second]), blocks))


def hit_rows(rows: Rows, text: str, block: ItemBlock) -> DataFrame:
    """(row, starts, ends, items) of the documents in which windows of the block occur."""
    row = free_name(rows.docs, "hit_row")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, ends, found = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), byte_lists(batch.column(1)), strict=True):
                spans, items = block.occurring(block.numbers(t)[1])
                if spans:
                    at.append(k)
                    starts.append([s for s, _ in spans])
                    ends.append([e for _, e in spans])
                    found.append(sorted(items))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(starts, lists), pa.array(ends, lists), pa.array(found, pa.list_(pa.string()))], names=["row", "starts", "ends", "items"])

    return rows.numbered(row).select(row, F.col(text).cast("string")).mapInArrow(scan, "row long, starts array<int>, ends array<int>, items array<string>")


def all_hits(rows: Rows, text: str, blocks: Iterator[ItemBlock]) -> DataFrame:
    """The hits of all blocks, each written before the next block is made; a row for each block and document."""
    out = None
    for block in blocks:
        written = cut(hit_rows(rows, text, block))
        out = written if out is None else out.unionByName(written)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
                  window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with all their columns."""
    block, blocks = one_or_more(ready_blocks(docs, items, text, item_text, item_id, window, block_words), window)
    if block is None:
        rows = Rows(docs)
        hit = cut(all_hits(rows, text, blocks).select("row").distinct())
        out = rows.pick(hit, keep=False)
        release(hit)
        return out
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [bool(block.occurring(block.numbers(t)[1])[0]) for t in byte_lists(batch.column(at))]
            yield batch.filter(pa.array([not x for x in hit], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
                  item_id: str = "item_id", window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """Per document: doc_id, n_words, the places (``starts``, ``ends``) of each window found, and ``items``."""
    block, blocks = one_or_more(ready_blocks(docs, items, text, item_text, item_id, window, block_words), window)
    if block is None:
        return merged_hits(docs, text, doc_id, blocks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, starts, ends, found = [], [], [], []
            for t in byte_lists(batch.column(1)):
                n, ids = block.numbers(t)
                spans, items = block.occurring(ids)
                n_words.append(n)
                starts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
                found.append(sorted(items))
            lists = pa.list_(pa.int32())
            new = [pa.array(n_words, pa.int64()), pa.array(starts, lists), pa.array(ends, lists), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["doc_id", "n_words", "starts", "ends", "items"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>")


def merged_hits(docs: DataFrame, text: str, doc_id: str, blocks: Iterator[ItemBlock]) -> DataFrame:
    """``contamination`` for more than one block: what the blocks found, by document."""
    rows = Rows(docs)
    row = free_name(docs, "hit_row")
    found = all_hits(rows, text, blocks)
    whole = lambda c: F.flatten(F.collect_list(c)).alias(c)
    # A document has a row for each block that hits it; lists of one document are as long as its hits.
    spans = found.select("row", F.arrays_zip("starts", "ends").alias("spans"), "items").groupBy("row").agg(whole("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(words_of(t)) for t in byte_lists(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["row", "doc_id", "n_words"])

    counted = rows.numbered(row).select(F.col(row), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(count, "row long, doc_id long, n_words long")
    out = counted.join(spans, "row", "left")
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return out.select(
        "doc_id", "n_words", F.coalesce(F.col("spans.starts"), none("int")).alias("starts"), F.coalesce(F.col("spans.ends"), none("int")).alias("ends"),
        F.coalesce("items", none("string")).alias("items"),
    )


def contamination_report(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any found window), n_items, items_sha256, contaminated."""
    found = contamination(docs, items, **options)  # type: ignore[arg-type]
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    reach = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")),
        lambda a, x: F.struct(
            (a["hit"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["starts"], a["upto"]))).alias("hit"),
            F.greatest(a["upto"], x["ends"]).alias("upto"),
        ),
        lambda a: a["hit"].cast("long"),
    )
    return found.select(
        "doc_id", "n_words", reach.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = 10) -> list[tuple]:
    """The report of a few documents by comparing every window with every place."""
    out = []
    for doc_id, text in docs:
        w = words_of(text.encode() if text else None)
        hit, found = set(), set()
        for item_id, item in items:
            x = words_of(item.encode() if item else None)
            n = min(window, len(x))
            for i in range(len(x) - n + 1 if x else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[i : i + n]:
                        hit.update(range(p, p + n))
                        found.update([str(item_id)] * (item_id is not None))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


REPORT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (
  SELECT item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
bw AS (SELECT item_id, least(10, len(words)) AS n, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS gram FROM bw),
sizes AS (SELECT DISTINCT n FROM w),
p AS (SELECT r, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n),
hits AS (SELECT r, p.n, i, item_id FROM (SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram FROM p) p JOIN w ON p.n = w.n AND p.gram = w.gram),
hw AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""
