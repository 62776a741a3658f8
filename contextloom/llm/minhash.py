"""MinHash near-duplicates from bottom-k sketches of one hash function.

The set of a document is that of its distinct two-word shingles, each one 64-bit hash. Documents with equal sets form a
class; from there on a class is one row. Two classes are linked when their Jaccard similarity is at least
``percent`` / 100.

Sketch. The hash space is dealt into ``CELLS`` cells by the low bits of the hash, and of each cell the ``KEPT`` smallest hashes
are retained: a bottom-k sketch of at most ``CELLS`` * ``KEPT`` values from a single hash function. The sketch of a union follows
from the two sketches, cell by cell, and the share of its values that both sets have estimates their similarity.

Inverted lists. A pair of two-word shingles is found in many texts, and so is one retained value; a list of those
would hold a good part of any large corpus. So a list stands for all that a cell retains: documents are in it when the
``depth`` smallest hashes of that cell are the same. Two linked sets agree in a cell with a probability of their similarity to the power
of ``depth``, which is chosen such that some cell agrees but for 2e-11 at the threshold itself (``depth`` is 4 at 80 %), and for much less
above it. Every list of more than one document counts, however long. Sets of under ``SMALL`` shingles have too few to fill cells; they go
by their whole exact prefix in the order of rarity instead, where nothing can be missed. Sets of sizes that may be linked with ones on
either side of ``SMALL`` do both.

Pairs. As in ``ngram_jaccard``: each list first pairs its members with one pivot, so that groups of copies cost pairs in
proportion to their size; lists that still hold several components give the pairs across these that sizes and bitmaps
allow, in cells of bounded size, and the members of very long ones meet at their rarest shingles. Pairs are held
against the union sketch: one that shares fewer of its values than a linked pair would but for a probability of ``MISS`` goes. All others
are confirmed on their full sets, made anew from the texts of just those documents.

Defined cases: null and wordless texts have an empty set and are linked with nothing; a text of one word has one
shingle, that word; repeated rows and ids come out once each; a null doc_id comes after all others; an empty table gives an
empty result; further columns are kept by ``minhash_dedup`` whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm import ngram_jaccard as near
from contextloom.llm.common import Rows, byte_lists, cut, free_name, scratch, ship, with_numbers

SHINGLE, PERCENT = 2, 80
CELLS, KEPT = 48, 4
SMALL = 128
MISS = 2.0**-40
LOST, FEWER = 2e-11, 1e-8  # chances that a pair at the threshold shares no list, or no more than ``spare_lists``
PAD = np.uint32(0xFFFFFFFF)


def list_depth(percent: int) -> int:
    """How many values of a cell make a list: as many as leave a linked pair without a common list only for ``LOST``."""
    return max([1, *(d for d in range(1, KEPT + 1) if (1 - (percent / 100) ** d) ** CELLS <= LOST)])


def spare_lists(percent: int) -> int:
    """Linked pairs share more lists than these but for ``FEWER``: a bound that tests hold, no list is left out for it."""
    agree = (percent / 100) ** list_depth(percent)
    below, k = 0.0, 0
    while (below := below + math.comb(CELLS, k) * agree**k * (1 - agree) ** (CELLS - k)) <= FEWER:
        k += 1
    return max(0, k - 1)


def least_shared(percent: int) -> np.ndarray:
    """For each size of a union sketch the fewest shared values that a linked pair has but for ``MISS``."""
    t, out = percent / 100, []
    for size in range(CELLS * KEPT + 1):
        below, m = 0.0, 0
        while m < size and (below := below + math.comb(size, m) * t**m * (1 - t) ** (size - m)) <= MISS:
            m += 1
        out.append(m)
    return np.array(out)


def retained(h: np.ndarray) -> np.ndarray:
    """The ``KEPT`` smallest of each cell of a sorted set, in order, as (CELLS, KEPT) places in it; -1 where there are none."""
    cell = (h % np.uint64(CELLS)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    rank = np.arange(len(h)) - np.searchsorted(cell, np.arange(CELLS))[cell]
    out = np.full((CELLS, KEPT), -1, np.int64)
    first = rank < KEPT
    out[cell[first], rank[first]] = order[first]
    return out


def sketch_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The retained values by their upper 32 bits, which order them; ``PAD`` where a cell has fewer."""
    return np.append(np.minimum((h >> np.uint64(32)).astype(np.uint32), PAD - np.uint32(1)), PAD)[at]


def list_keys(h: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """A key for each cell that isn't empty: the hash of its number and its ``depth`` smallest values."""
    values = np.append(h, np.uint64(0))[at]
    key = np.arange(1, CELLS + 1, dtype=np.uint64) * near.MIX
    for j in range(depth):
        key = (key ^ values[:, j]) * near.MIX
        key ^= key >> np.uint64(32)
    return key[at[:, 0] >= 0].view(np.int64)


def union_overlap(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sketches (m, CELLS, KEPT): how many values the sketch of the union has, and how many of them both sets have."""
    both = (x[..., :, None] == y[..., None, :]).any(-1) & (x != PAD)
    own = np.where((y[..., :, None] == x[..., None, :]).any(-1), PAD, y)
    union = np.sort(np.concatenate([x, own], -1), -1)[..., :KEPT]
    return (union != PAD).sum((1, 2)), (both & (x <= union[..., -1:])).sum((1, 2))


def set_rows(rows: Rows, text: str, doc_id: str, percent: int) -> DataFrame:
    """Per document: row, doc_id, n, digest of the set, its bitmap, its sketch, and list keys where cells are filled. Written."""
    ship(rows.docs.sparkSession)
    row, depth = free_name(rows.docs, "near_row"), list_depth(percent)
    picked = rows.numbered(row).select(F.col(row), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = near.WordHashes()
        for batch in batches:
            n, digests, bits, sketch, keys = [], [], [], [], []
            for t in byte_lists(batch.column(2)):
                h = near.shingle_set(t, hashes, SHINGLE)
                at = retained(h)
                n.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                bits.append(near.bitmap(h).tobytes())
                sketch.append(sketch_of(h, at).tobytes())
                keys.append(list_keys(h, at, depth) if 100 * len(h) >= SMALL * percent else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, bits, sketch)), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n", "digest", "bits", "sketch", "keys"],
            )

    return cut(picked.mapInArrow(sets, "row long, doc_id long, n long, digest binary, bits binary, sketch binary, keys array<long>"))


def likely_pairs(sketched: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` (written) whose bitmaps and union sketch allow a link. Written."""
    least = least_shared(percent)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(near.allowed(batch, percent)))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, CELLS, KEPT) for i in (6, 7))
            size, shared = union_overlap(x, y)
            yield batch.select(["a", "b"]).filter(pa.array(shared >= least[size]))

    return cut(near.sided(sketched, pairs, "n", "bits", "sketch").mapInArrow(judged, "a long, b long"))


def near_rows(rows: Rows, text: str, doc_id: str, percent: int) -> DataFrame:
    """One row per document: row, doc_id, n_shingles, class_id, component_id, class_size."""
    with scratch(rows.docs.sparkSession) as made:
        sets = set_rows(rows, text, doc_id, percent)
        classes = cut(
            sets.where("n > 0").groupBy("digest", "n").agg(F.min("row").alias("rep"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size"))
        )
        sketched = with_numbers(sets, "row", classes.select("rep")).withColumnRenamed("row", "rep")
        short = near.rare_prefixes(rows, text, sketched.where(F.col("n") < SMALL).select("rep", "n"), percent, SHINGLE)
        lists = sketched.select(F.explode("keys").alias("key"), "rep", "n").unionByName(short.join(sketched.select("rep", "n"), "rep").select(F.explode("keys").alias("key"), "rep", "n"))

        def linked(pairs: DataFrame) -> DataFrame:
            return near.exact_pairs(rows, text, likely_pairs(sketched, pairs, percent), percent, shingle=SHINGLE)

        comps = near.components_of(lists, percent, linked, lambda tiles: near.tile_pairs(rows, text, tiles, sketched, percent, SHINGLE))
        by_class = near.class_components(classes, comps)
        made.keep(sets, by_class)
    return near.with_classes(sets, by_class)


def minhash_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per document: row, doc_id, n_shingles, class_id and component_id (smallest doc_ids), class_size."""
    return near_rows(Rows(docs), text, doc_id, percent)


def minhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest doc_id.

    Documents without words all stay, and so do components without any doc_id. Of rows that repeat that doc_id one stays.
    """
    return near.firsts_of(Rows(docs), lambda rows: near_rows(rows, text, doc_id, percent))


def minhash_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and whether it has the component's id."""
    found = minhash_duplicates(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


REPORT_SQL = f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({near.report_sql(SHINGLE, PERCENT)})"
