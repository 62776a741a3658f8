"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one sets, for every row, two bits of a blocked Bloom filter and keeps the bits that were set at least twice.
Pass two tests every row against those: a row of which either bit was set once has no equal and passes straight
through; only the others, real repeats and a few false positives, shuffle. The filter has ``bits_per_row`` bits a row at
any size. Up to ``max_filter_bits`` bits it goes to the rows by broadcast; a larger one stays in its blocks, and rows
go there as a hash and a number of eight bytes each, then are told apart by their numbers (``common.Rows``): texts of
unique rows don't shuffle there either.

Defined cases: a null text counts as empty; texts of white space only equal one another (one space) but not the empty
text; of rows with equal text the smallest doc_id stays, a null doc_id comes after all others; among repeated rows
(equal text and doc_id) exactly one stays; an empty table gives an empty result; further columns are kept, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextloom.llm.common import WHITE, Rows, bit_is_set, cut, free_name, quoted, text_of
from contextloom.llm.components import join_groups

BLOCK_BITS = 32768  # of bitmap_construct_agg
LAST_ID = (1 << 63) - 1
HOT_ROWS, MAX_HOT = 1000, 10_000


def normalised(text: Column | str) -> Column:
    """The text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_of(text), WHITE, " ")


def repeated_bits(hashes: DataFrame, h: str, blocks: int) -> DataFrame:
    """(block, bitmap, size) of the filter bits that at least two rows of ``hashes`` set; ``h`` is a 64-bit hash.

    ``size`` counts how often these bits were set, so a block that many equal rows meet in has a large one.
    """
    bits = hashes.select(_block(h, blocks).alias("block"), F.explode(F.array(*_bits(h))).alias("bit"))
    counted = bits.groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.repartition("block").groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"), F.sum("n").alias("size"))


def _block(h: str, blocks: int) -> Column:
    return F.pmod(F.col(h), F.lit(blocks)).cast("long")


def _bits(h: str) -> list[Column]:
    """Two bits of a block. They are kept apart (even and odd), so one row never sets a bit twice."""
    mask = F.lit(BLOCK_BITS // 2 - 1).cast("long")
    return [
        (F.shiftrightunsigned(F.col(h), n).bitwiseAND(mask) * 2 + odd).cast("long") for n, odd in ((18, 0), (40, 1))
    ]


def filter_blocks(n_rows: int, bits_per_row: int) -> int:
    return max(1, -(-max(n_rows, 1) * bits_per_row // BLOCK_BITS))


def maybe_repeated(rows: DataFrame, h: str, flag: str, blocks: int) -> DataFrame:
    """``rows`` with a boolean column ``flag``: false only for rows whose hash occurs once. The filter is broadcast."""
    block, bitmap = free_name(rows, "bloom_block"), free_name(rows, "bloom_bitmap")
    twice = repeated_bits(rows.select(h), h, blocks).select(F.col("block").alias(block), F.col("bitmap").alias(bitmap))
    joined = rows.withColumn(block, _block(h, blocks)).join(F.broadcast(twice), block, "left")
    hit = F.col(bitmap).isNotNull() & bit_is_set(F.col(bitmap), _bits(h)[0]) & bit_is_set(F.col(bitmap), _bits(h)[1])
    return joined.withColumn(flag, hit).drop(block, bitmap)


def routed_repeated(hashes: DataFrame, blocks: int, n_rows: int) -> DataFrame:
    """The numbers of (number, h) whose hash may be repeated. Rows go to the filter's blocks, which nobody broadcasts.

    Of the blocks only those few that hold more than one row in ``MAX_HOT`` go to their rows instead.
    """
    twice = cut(repeated_bits(hashes, "h", blocks))
    met = join_groups(hashes.withColumn("block", _block("h", blocks)), twice, "block", "size", n_rows)
    return met.where(bit_is_set(F.col("bitmap"), _bits("h")[0]) & bit_is_set(F.col("bitmap"), _bits("h")[1])).select("number")


def split_repeated(docs: DataFrame, h: Column, bits_per_row: int, max_filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash ``h`` occurs once, and those whose hash may be repeated."""
    n_rows = docs.count()
    blocks = filter_blocks(n_rows, bits_per_row)
    if blocks * BLOCK_BITS <= max(max_filter_bits, 0):
        name, flag = free_name(docs, "dedup_hash"), free_name(docs, "dedup_maybe")
        rows = maybe_repeated(docs.withColumn(name, h), name, flag, blocks)
        return rows.where(~F.col(flag)).select(*quoted(docs.columns)), rows.where(F.col(flag)).select(*quoted(docs.columns))
    rows = Rows(docs)
    number = free_name(docs, "dedup_number")
    hashes = cut(rows.numbered(number).select(F.col(number).alias("number"), h.alias("h")))
    again = cut(routed_repeated(hashes, blocks, n_rows))
    return rows.pick(again, keep=False), rows.pick(again, keep=True)


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 28,
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that the filter clears are never shuffled. The others are reduced to one a text by ``min_by``, which combines
    on the map side, so that a text that a third of all rows share leaves each task as one row.
    """
    once, again = split_repeated(docs, F.xxhash64(normalised(text)), bits_per_row, max_filter_bits)
    key = free_name(docs, "dedup_sha")
    hashable = [c.name for c in docs.schema.fields if not isinstance(c.dataType, (T.MapType, T.VariantType))]
    order = F.struct(F.coalesce(F.col(doc_id), F.lit(LAST_ID)), F.xxhash64(*quoted(hashable)))
    firsts = (
        again.withColumn(key, F.sha2(normalised(text), 256))
        .groupBy(key)
        .agg(F.min_by(F.struct(*quoted(docs.columns)), order).alias("dedup_row"))
        .select("dedup_row.*")
    )
    return once.unionByName(firsts)


def exact_dedup_report(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    bits_per_row: int = 16,
    max_filter_bits: int = 1 << 28,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The texts are read once: their digests are written to the shared folder, and both passes go over those.
    The groups of possibly repeated texts are counted with map-side combining and joined back to their rows. Groups of
    more than one row in ``MAX_HOT`` are at most ``MAX_HOT`` in number, so these go to the rows by broadcast, and no
    task has to take in a large group.
    """
    digests = cut(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.sha2(normalised(text), 256).alias("text_sha256"),
        )
    )
    n_rows = digests.count()
    once, again = split_repeated(digests, F.xxhash64("text_sha256"), bits_per_row, max_filter_bits)
    once = once.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("o"), "row", "doc_id"))
    groups = cut(again.groupBy("text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
    hot_size = max(HOT_ROWS, n_rows // MAX_HOT)
    hot = F.broadcast(groups.where(F.col("group_size") > hot_size))
    small = groups.where(F.col("group_size") <= hot_size)
    by_hot = again.join(hot, "text_sha256")
    by_small = again.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(small, "text_sha256")
    decided = [
        j.select(
            "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
            (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256",
        )
        for j in (by_hot, by_small)
    ]
    return once.unionByName(decided[0]).unionByName(decided[1])


REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         row_number() OVER () AS r
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r)
"""
