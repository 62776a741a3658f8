"""Near-duplicate join on word shingles: size-banded tiles, bitmap signatures, exact intersection.

The set of a document is that of its distinct five-word shingles, each a 64-bit hash, held as a sorted array. Documents
with equal sets form a class; from there on a class is one row. Two classes are linked when their Jaccard similarity
is at least ``percent`` / 100.

Tiles. Comparing whole size bands with one another grows with the square of the corpus, so a tile holds the classes
that share one of their ``KEYS`` smallest shingle hashes, and large tiles are cut into size bands and then into cells
of bounded size. A set of at most 4 * ``KEYS`` - 4 shingles sends its whole exact prefix, so no link can be missed; of a
larger pair, none of the ``KEYS`` smallest hashes of the union is shared with a probability under 0.25 ** KEYS = 2 ** -64
at most, as small as that of two shingles having one hash.

Pairs. In a first round each tile pairs its members with one pivot only: the member whose keys the most others share,
so the one in the middle of a group of copies. That links large groups with pairs in proportion to their size. Components
of those links are found; in a second round tiles that still hold more than one component give all pairs across
components that sizes and bitmaps allow. Pairs within a component need no look. Tiles of more than ``CELL`` classes that
are still mixed then are those of passages which otherwise different documents share. Their members are tiled anew by
exact prefixes in the order of rarity (``rare_tiles``), where common shingles come last, so work grows with the members
and not with their square. Only documents of which such passages make up three quarters or more still meet there. In a bitmap every shingle sets one bit; a bit that only one of two sets has stands for at least
one shingle of its own, which bounds the overlap from above. Pairs that pass meet their sorted arrays, made anew from
the texts of just those documents, and are intersected exactly. ``near_links`` gives all links with their similarity.

Defined cases: null and wordless texts have an empty set and are linked with nothing; a text of fewer than five words
has one shingle, all its words; repeated rows and ids come out once each; a null doc_id comes after all others; an
empty table gives an empty result; further columns are kept by ``near_dedup`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contextloom.llm.common import Rows, byte_lists, cut, free_name, release, scratch, ship, spaced_words, with_numbers
from contextloom.llm.components import connected_components, join_groups

SHINGLE = 5
KEYS = 32
MIX = np.uint64(0x9E3779B97F4A7C15)
CELL = 2048
PIVOTS, LARGE_TILE = 4, 256
LESSER = 96  # keys of other tiles that a row takes along, so that a pair comes from one tile
SMALL_BITS, LARGE_BITS = 8, 13  # bitmaps have 2 ** 8 to 2 ** 13 bits
BITS_PER_SHINGLE = 4
SLOT_BITS, SLOT_LOAD, SLOT_BLOCK = 24, 16, 1 << 14  # the table of frequencies has at most 2 ** 24 slots, 16 shingles in each if it may


class WordHashes(dict):
    """Word -> place in ``values``, an array of 64-bit hashes; starts anew when it has grown large."""

    def __init__(self, most: int = 150_000):
        self.most, self.values = most, np.empty(1024, np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == len(self.values):
            self.values = np.resize(self.values, 2 * k)
        self.values[k] = xxhash.xxh3_64_intdigest(word)
        self[word] = k
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.values[at]


def shingle_set(text: bytes | None, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    w = hashes.of(words)
    size = min(shingle, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : i + len(h)]) * MIX
        h ^= h >> np.uint64(32)
    return np.unique(h)


def bitmap_bits(n: int) -> int:
    """log2 of the bits of the signature of a set of n: at least ``BITS_PER_SHINGLE`` times n of them, within bounds."""
    return min(max((BITS_PER_SHINGLE * n - 1).bit_length(), SMALL_BITS), LARGE_BITS)


def bitmap(h: np.ndarray) -> np.ndarray:
    """The signature as 64-bit words: one bit for each hash, by its low bits."""
    bits = bitmap_bits(len(h))
    seen = np.zeros(1 << bits, np.uint8)
    seen[h & np.uint64((1 << bits) - 1)] = 1
    return np.packbits(seen, bitorder="little").view(np.uint64)


def most_overlap(bx: np.ndarray, by: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of sets with signatures ``bx`` and ``by`` (same number of bits; last axis: words)."""
    only_x = np.bitwise_count(bx & ~by).sum(-1, dtype=np.int64)
    only_y = np.bitwise_count(by & ~bx).sum(-1, dtype=np.int64)
    return np.minimum(nx - only_x, ny - only_y)


def enough(overlap: np.ndarray | int, nx: np.ndarray | int, ny: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * overlap >= percent * (nx + ny - overlap)


def folded(b: np.ndarray, words: int) -> np.ndarray:
    """A signature of fewer bits: the parts laid over one another."""
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] | b[..., half:]
    return b


def set_rows(rows: Rows, text: str, doc_id: str) -> DataFrame:
    """Per document: row, doc_id, n, digest of the set, its smallest hashes, its bitmap. Written."""
    ship(rows.docs.sparkSession)
    row = free_name(rows.docs, "near_row")
    picked = rows.numbered(row).select(F.col(row), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digests, keys, bits = [], [], [], []
            for t in byte_lists(batch.column(2)):
                h = shingle_set(t, hashes)
                n.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                keys.append(h[:KEYS].view(np.int64))
                bits.append(bitmap(h).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["row", "doc_id", "n", "digest", "keys", "bits"],
            )

    return cut(picked.mapInArrow(sets, "row long, doc_id long, n long, digest binary, keys array<long>, bits binary"))


def size_fits(na: str, nb: str, percent: int) -> Column:
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent).cast("boolean")


def ends_of(pairs: DataFrame) -> DataFrame:
    """(rep): both sides of some pairs (a, b), as often as they are there."""
    return pairs.select(F.explode(F.array("a", "b")).alias("rep"))


def sided(classes: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b; written) with some columns of both their ``classes``; of the others nothing shuffles."""
    some = with_numbers(classes, "rep", ends_of(pairs))
    one = lambda c: some.select(F.col("rep").alias(c), *(F.col(x).alias(f"{x}{c}") for x in columns))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", *(f"{x}{c}" for x in columns for c in "ab"))


def allowed(batch: pa.RecordBatch, percent: int) -> np.ndarray:
    """Which pairs (a, b, na, nb, bitsa, bitsb) the bitmaps allow."""
    na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
    keep = np.zeros(len(na), bool)
    for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
        bx, by = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        words = min(len(bx), len(by))
        keep[i] = enough(most_overlap(folded(bx, words), folded(by, words), na[i], nb[i]), na[i], nb[i], percent)
    return keep


def bounded_pairs(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` (written) that the bitmaps of ``classes`` (rep, n, bits) allow. Written."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(allowed(batch, percent)))

    return cut(sided(classes, pairs, "n", "bits").mapInArrow(bounded, "a long, b long"))


def exact_pairs(rows: Rows, text: str, pairs: DataFrame, percent: int, overlaps: bool = False, shingle: int = SHINGLE) -> DataFrame:
    """Those (a, b) of ``pairs`` (written) that are linked, with their overlap if wanted, by their whole sorted arrays. Written."""
    arrays = cut(set_arrays(rows, text, ends_of(pairs), shingle))
    side = lambda c: arrays.select(F.col("rep").alias(c), F.col("hashes").alias(f"hashes{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "hashesa", "hashesb")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, shared = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                hx, hy = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared.append(len(np.intersect1d(hx, hy, assume_unique=True)))
                keep.append(bool(enough(shared[-1], len(hx), len(hy), percent)))
            out = batch.select(["a", "b"])
            if overlaps:
                out = out.append_column("overlap", pa.array(shared, pa.int64()))
            yield out.filter(pa.array(keep, pa.bool_()))

    out = cut(met.mapInArrow(linked, "a long, b long, overlap long" if overlaps else "a long, b long"))
    release(arrays)
    return out


def near_pairs(rows: Rows, text: str, classes: DataFrame, pairs: DataFrame, percent: int, overlaps: bool = False) -> DataFrame:
    """Those (a, b) of ``pairs`` that are linked, with their overlap if wanted: bitmaps first, then the sorted arrays."""
    return exact_pairs(rows, text, bounded_pairs(classes, pairs, percent), percent, overlaps)


def set_arrays(rows: Rows, text: str, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(rep, hashes): the sorted arrays of the ``wanted`` classes, from the texts of their first rows."""
    rep = free_name(rows.docs, "near_rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(t, hashes, shingle).tobytes() for t in byte_lists(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "hashes"])

    return rows.pick(wanted, True, rep).select(F.col(rep), F.col(text).cast("string")).mapInArrow(sets, "rep long, hashes binary")


def pivot_pairs(keyed: DataFrame, percent: int) -> DataFrame:
    """Each tile's members with its pivot."""
    out = keyed.where((F.col("rep") != F.col("pivot")) & size_fits("n", "pivot_n", percent))
    return out.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()


def more_pairs(tiles: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """The members of the tiles of some ``keys`` with the ``PIVOTS`` heaviest ones of their tile that aren't in their component.

    A large component so meets pivots of others only; its members aren't looked at otherwise.
    """
    heaviest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "rep"))
    pivots = tiles.withColumn("place", heaviest).where(F.col("place") <= PIVOTS).join(keys, "key", "left_semi")
    pivots = pivots.select("key", F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"), F.col("comp").alias("pivot_comp"))
    return pivot_pairs(tiles.join(pivots, "key").where("comp <> pivot_comp"), percent)


def with_components(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """key, c, rep, n, weight and the component that the links so far give."""
    comps = connected_components(links).withColumnRenamed("node", "rep")
    return keyed.join(comps, "rep", "left").select("key", "c", "rep", "n", "weight", F.coalesce("component", "rep").alias("comp"))


def lesser_keys(tiles: DataFrame) -> DataFrame:
    """``tiles`` with keys: of the tiles that a row's class is in, the ``LESSER`` keys before that of the row.

    Two rows that share one of these leave their pair to that tile. The first tile that they share always gives it.
    """
    return tiles.withColumn("keys", F.collect_list("key").over(Window.partitionBy("rep").orderBy("key").rowsBetween(-LESSER, -1)))


def cross_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of a tile in different components that sizes and bitmaps allow; some come more than once.

    ``tiles``: key, c (the tile's rows), rep, comp, n, keys (``lesser_keys``), bits. A tile of more than ``CELL`` rows is cut by
    size bands, each a quarter wide so that links only join a band and the next, and a band into cells of two blocks of
    about ``CELL`` rows. A task holds one cell at a time.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long")
    blocks = F.ceil(F.col("c") / CELL).cast("int")
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    cells = F.when(F.col("c") <= CELL, F.array(F.struct(F.lit(-1).cast("long").alias("band"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), F.lit(0).alias("up")))).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda up: F.transform(F.sequence(F.lit(0), blocks - 1), lambda q: F.struct(
            (band - up).cast("long").alias("band"), F.least(block, q).alias("x"), F.greatest(block, q).alias("y"), block.alias("side"), up.alias("up")))))
    )
    dealt = tiles.select("key", "rep", "comp", "n", "bits", "keys", F.explode(cells).alias("cell")).select("key", "cell.*", "rep", "comp", "n", "bits", "keys")
    place = F.xxhash64("key", "band", "x", "y")
    dealt = dealt.select(place.alias("place"), "x", "y", "side", "up", "rep", "comp", "n", "bits", "keys")
    ready = dealt.repartition("place").sortWithinPartitions("place", "n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            places = t.column("place").to_numpy()
            ends = np.flatnonzero(places[1:] != places[:-1]) + 1
            start = 0
            for end in ends.tolist():
                yield from _cell_pairs(t.slice(start, end - start), percent)
                start = end
            rest = t.slice(start)
        if rest is not None and len(rest):
            yield from _cell_pairs(rest, percent)

    return ready.mapInArrow(compare, "a long, b long")


def shingle_levels(rows: Rows, text: str, members: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How common shingles are in the texts of ``members`` (rep, n): by slot of their hash, the bit length of its count.

    Every shingle of every member counts. A task counts up to 255 in a slot and sends a byte for each of a fixed number of
    slots, so neither the shuffle nor the 16 MB at most that reach the driver grow with the texts beyond that.
    """
    total = members.agg(F.sum("n")).first()[0] or 0
    slots = 1 << min(max((total // SLOT_LOAD).bit_length(), 16), SLOT_BITS)
    mask, rep = np.uint64(slots - 1), free_name(rows.docs, "near_rep")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(slots, np.uint8)
        for batch in batches:
            for t in byte_lists(batch.column(0)):
                at, n = np.unique(shingle_set(t, hashes, shingle) & mask, return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 255)
        for block in range(slots // SLOT_BLOCK):
            part = counts[block * SLOT_BLOCK : (block + 1) * SLOT_BLOCK]
            if part.any():
                yield pa.record_batch({"block": pa.array([block], pa.int64()), "counts": pa.array([part.tobytes()], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(SLOT_BLOCK, np.int64)

        def level() -> pa.RecordBatch:
            return pa.record_batch({"block": pa.array([at], pa.int64()), "levels": pa.array([np.frexp(total)[1].astype(np.uint8).tobytes()], pa.binary())})

        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != at:
                    if at is not None:
                        yield level()
                    at, total = block, np.zeros(SLOT_BLOCK, np.int64)
                total += np.frombuffer(counts.as_buffer(), np.uint8)
        if at is not None:
            yield level()

    texts = rows.pick(members.select("rep"), True, rep).select(F.col(text).cast("string"))
    blocks = texts.mapInArrow(counted, "block long, counts binary").repartition("block").sortWithinPartitions("block")
    levels = np.zeros(slots, np.uint8)
    for r in blocks.mapInArrow(added, "block long, levels binary").collect():  # at most 2 ** SLOT_BITS bytes in all
        levels[r.block * SLOT_BLOCK : (r.block + 1) * SLOT_BLOCK] = np.frombuffer(r.levels, np.uint8)
    return levels


def rare_prefixes(rows: Rows, text: str, members: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """rep, keys, bits of ``members`` (rep, n): the first shingles in the order of rarity, and the bitmap. Written.

    A set of n sends its whole exact prefix, the n - ceil(n * percent / 100) + 1 first of its shingles. Any one order of
    all shingles makes that exact; this one goes by frequency, then by hash. Frequencies are by slots of the hash, which
    may hold several shingles: that may place a shingle later than need be, but alike in all sets.
    """
    levels = shingle_levels(rows, text, members, shingle)
    mask, rep = np.uint64(len(levels) - 1), free_name(rows.docs, "near_rep")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, bits = [], []
            for t in byte_lists(batch.column(1)):
                h = shingle_set(t, hashes, shingle)
                order = np.argsort(levels[h & mask], kind="stable")  # h is sorted
                keys.append(h[order[: len(h) + 1 - (len(h) * percent + 99) // 100]].view(np.int64))
                bits.append(bitmap(h).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["rep", "keys", "bits"])

    texts = rows.pick(members.select("rep"), True, rep).select(F.col(rep), F.col(text).cast("string"))
    return cut(texts.mapInArrow(prefixes, "rep long, keys array<long>, bits binary"))


def rare_tiles(rows: Rows, text: str, members: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """key, c, rep, comp, n, keys, bits: tiles of ``members`` (rep, comp, n; written) that hold more than one component.

    Members send their exact prefixes in the order of rarity (``rare_prefixes``).
    """
    sets = rare_prefixes(rows, text, members, percent, shingle)
    keys = sets.select("rep", F.explode("keys").alias("key"))
    counts = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    met = cut(join_groups(keys, counts, "key", "c", keys.count()).select("key", "c", "rep").join(members, "rep"))
    mixed = cut(met.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("key", "m"))
    open_rows = join_groups(met, mixed, "key", "m", met.count()).select("key", "c", "rep", "comp", "n")
    return lesser_keys(open_rows).join(sets.select("rep", "bits"), "rep")


def _cell_pairs(t: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    n, rep, comp, side, up, x, y = (t.column(c).to_numpy() for c in ("n", "rep", "comp", "side", "up", "x", "y"))
    if len(n) < 2 or comp.min() == comp.max():
        return
    apart = bool(x[0] != y[0])  # two blocks: only pairs across them
    words = [np.frombuffer(b, np.uint64) for b in t.column("bits").to_pylist()]
    own = [frozenset(k) for k in t.column("keys").to_pylist()]
    width = np.array([len(w) for w in words])
    at_width: dict[int, np.ndarray] = {}
    for w in np.unique(width):  # rows are in order of n, so of width; signatures of this width and the next, folded
        upto = np.searchsorted(width, 2 * w, "right")
        at_width[int(w)] = np.stack([folded(words[i], w) for i in range(np.searchsorted(width, w), upto)])
    for i in range(len(n) - 1):
        last = np.searchsorted(n, n[i] * 100 // percent, "right")
        if last <= i + 1:
            continue
        fits = comp[i + 1 : last] != comp[i]
        if apart:
            fits &= side[i + 1 : last] != side[i]
        if up[i]:  # two rows of the next band meet in that band's own cell
            fits &= up[i + 1 : last] == 0
        j = np.flatnonzero(fits) + i + 1
        if len(j):
            b = at_width[int(width[i])]
            base = int(np.searchsorted(width, width[i]))
            over = most_overlap(b[i - base], b[j - base], n[i], n[j])
            j = j[enough(over, n[i], n[j], percent)]
            j = j[[own[i].isdisjoint(own[k]) for k in j.tolist()]] if len(j) else j
        if len(j):
            yield pa.record_batch({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])})


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 75) -> DataFrame:
    """One row per document: row, doc_id, n_shingles, class_id and component_id (smallest doc_ids), class_size.

    ``row`` is the number that ``common.Rows`` gives the document's row.
    """
    return near_rows(Rows(docs), text, doc_id, percent)


def classes_of(sets: DataFrame) -> DataFrame:
    """The classes of equal sets that aren't empty: digest, n, class_id, size, and rep, keys and bits of their first row. Written."""
    first = F.struct("row", "keys", "bits")
    return cut(
        sets.where("n > 0")
        .groupBy("digest", "n")
        .agg(F.min_by(first, "row").alias("r"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size"))
        .select("digest", "n", "class_id", "size", F.col("r.row").alias("rep"), F.col("r.keys").alias("keys"), F.col("r.bits").alias("bits"))
    )


def near_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 75) -> DataFrame:
    """All links between different sets: class_a, class_b, similarity; each pair of classes once, the lesser class_id first.

    ``near_duplicates`` gives the class_id of each document, so a document's links are those of its class and the other
    documents of the class. The tiles are those of ``near_duplicates``, but every pair of a tile that sizes and bitmaps
    allow is compared, so work and result grow with the links themselves: in a group of n texts that all differ and are all
    linked, with n * n / 2. Who needs the groups only takes ``near_duplicates``. Classes without any doc_id have a null
    class_id, which comes second.
    """
    rows = Rows(docs)
    with scratch(docs.sparkSession) as made:
        classes = classes_of(set_rows(rows, text, doc_id))
        keys = classes.select(F.explode("keys").alias("key"), "rep", "n")
        tiles = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        shared = cut(keys.join(tiles, "key").select("key", "c", "rep", "n", F.col("rep").alias("comp")))  # no class is settled beforehand
        pairs = cut(tile_pairs(rows, text, shared, classes, percent).distinct())
        one = lambda c: classes.select(F.col("rep").alias(c), F.col("class_id").alias(f"class_{c}"), F.col("n").alias(f"n{c}"))
        linked = near_pairs(rows, text, classes, pairs, percent, overlaps=True).join(one("a"), "a").join(one("b"), "b")
        swap = F.col("class_a").isNull() | (F.col("class_b") < F.col("class_a"))
        out = cut(linked.select(
            F.when(swap, F.col("class_b")).otherwise(F.col("class_a")).alias("class_a"), F.when(swap, F.col("class_a")).otherwise(F.col("class_b")).alias("class_b"),
            (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("similarity"),
        ))
        made.keep(out)
    return out


def near_rows(rows: Rows, text: str, doc_id: str, percent: int) -> DataFrame:
    with scratch(rows.docs.sparkSession) as made:
        sets = set_rows(rows, text, doc_id)
        classes = classes_of(sets)
        keys = classes.select(F.explode("keys").alias("key"), "rep", "n")
        comps = components_of(
            keys, percent, lambda pairs: near_pairs(rows, text, classes, pairs, percent), lambda tiles: tile_pairs(rows, text, tiles, classes, percent)
        )
        by_class = class_components(classes, comps)
        made.keep(sets, by_class)
    return with_classes(sets, by_class)


def class_components(classes: DataFrame, comps: DataFrame) -> DataFrame:
    """digest, class_id, size and component_id (the smallest class_id) of each class. Written."""
    ids = classes.select("digest", "n", "class_id", "size", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    ids = cut(ids.withColumn("component", F.coalesce("component", "rep")))
    lowest = cut(ids.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("n_classes")))
    return cut(join_groups(ids, lowest, "component", "n_classes", ids.count()).select("digest", "class_id", "size", "component_id"))


def with_classes(sets: DataFrame, by_class: DataFrame) -> DataFrame:
    """The rows of ``sets`` (row, doc_id, n, digest) with their class and component."""
    full = sets.where("n > 0").select("row", "doc_id", "n", "digest")
    out = join_groups(full, by_class, "digest", "size", sets.count())
    out = out.select("row", "doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", F.col("size").alias("class_size"))
    empty = sets.where("n = 0").select("row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(empty)


def tile_pairs(rows: Rows, text: str, tiles: DataFrame, classes: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """(a, b) across the components of ``tiles`` (key, c, rep, comp, n; written), large tiles anew by rarity; some twice."""
    found = cross_pairs(lesser_keys(tiles).where(F.col("c") <= CELL).join(classes.select("rep", "bits"), "rep"), percent)
    members = cut(tiles.where(F.col("c") > CELL).select("rep", "comp", "n").distinct())
    if not members.isEmpty():
        found = found.unionByName(cross_pairs(rare_tiles(rows, text, members, percent, shingle), percent))
    return found


def components_of(
    keys: DataFrame, percent: int, linked: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(node, component) of the linked classes, by their rep. Written.

    ``keys``: key, rep, n. ``linked`` gives those of some pairs (a, b) that are links; ``across`` gives pairs of different
    components in tiles (key, c, rep, comp, n; written).
    """
    tiles = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    weight = F.sum("c").over(Window.partitionBy("rep"))
    shared = cut(keys.join(tiles, "key").select("key", "c", "rep", "n", weight.alias("weight")))
    middle = F.max_by(F.struct("rep", "n"), F.struct("weight", -F.col("rep"))).alias("p")
    pivots = shared.groupBy("key").agg(middle)
    keyed = cut(shared.join(pivots, "key").select("key", "c", "rep", "n", "weight", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n")))
    release(shared)
    tried = cut(pivot_pairs(keyed, percent))
    links = linked(tried)
    labelled = cut(with_components(keyed, links))

    large = labelled.where(F.col("c") > LARGE_TILE)
    sizes = large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max("m").alias("m"), F.count(F.lit(1)).alias("k"))
    begun = sizes.where("k > 1 and m > 1").select("key")
    second = cut(more_pairs(large, begun, percent).join(tried, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        tried = tried.unionByName(second)
        links = cut(links.unionByName(linked(second)))
        release(labelled)
        labelled = cut(with_components(keyed, links))
    release(keyed)

    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    open_tiles = cut(labelled.join(mixed.select("key"), "key", "left_semi").drop("weight"))
    release(labelled)
    third = cut(across(open_tiles).distinct().join(tried, ["a", "b"], "left_anti"))
    release(open_tiles)
    links = links.unionByName(linked(third))
    return cut(connected_components(links))


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest doc_id.

    Documents without words are linked with nothing and all stay; components without any doc_id stay whole. Rows leave by
    their lasting numbers (``common.Rows``), whatever splits and executors later readings have; their texts never shuffle.
    """
    return firsts_of(Rows(docs), lambda rows: near_rows(rows, text, doc_id, percent))


def firsts_of(rows: Rows, near: Callable[[Rows], DataFrame]) -> DataFrame:
    """The rows that stay when only the smallest doc_id of each component of ``near`` (row, doc_id, n_shingles, component_id) does."""
    with scratch(rows.docs.sparkSession) as made:
        found = cut(near(rows).where("n_shingles > 0").select("row", "doc_id", "component_id"))
        some = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("size"))
        some = cut(some.where("size > 1 and component_id is not null"))
        left = join_groups(found.where("component_id is not null"), some, "component_id", "size", found.count())
        dropped = cut(left.where(F.col("row") != F.col("first.row")).select("row"))
        made.keep(dropped)
    out = rows.pick(dropped, keep=False)
    release(dropped)
    return out


def brute_force(docs: list[tuple[int, str | None]], percent: int = 75, shingle: int = SHINGLE) -> list[tuple[int, int, int]]:
    """(doc_id, n_shingles, component_id) of a few documents by comparing all of them."""
    sets = []
    for _, text in docs:
        w = spaced_words(text.encode() if text else None)
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(docs)]


def report_sql(shingle: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT r, words, unnest(range(1, greatest(len(words) - {shingle - 1}, 1) + 1)) AS i FROM d WHERE len(words) > 0),
s AS (SELECT DISTINCT r, array_to_string(words[i:i + {shingle - 1}], ' ') AS shingle FROM p),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach(r, c) AS (SELECT r, r FROM d UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.r)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM reach JOIN d ON d.r = reach.r JOIN d e ON e.r = reach.c LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""


REPORT_SQL = report_sql(SHINGLE, 75)
