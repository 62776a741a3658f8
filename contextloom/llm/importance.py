"""Importance resampling towards a target distribution, in DataFrame functions only.

Raw and target texts become bags of hashed n-grams: every run of 1 to ``max_n`` words counts in the bucket of its crc32.
A bucket's gain is the log ratio of its smoothed frequencies in target and raw texts; a document's weight is the sum of
the gains of its features; adding Gumbel noise that hangs on its id alone makes the highest scores a sample drawn
without replacement in proportion to the likelihood ratio.

Features are exploded and counted by bucket, combined before they shuffle, so the counts that meet are a row for each
bucket and task. The table of gains has one row for each of the ``buckets`` and goes to the features by broadcast; their
sums leave each task as a row for each document. Scores are written, then sorted over range partitions; a rank is the
place in the partition plus the rows of the partitions before it, of which there is a row each. Nothing but two totals,
the number of documents that may be drawn and no text reaches the driver, and no text is shuffled.

Defined cases: a null text has no words, so no features and weight 0; a document of fewer than ``min_words`` words is
counted and scored but never drawn; a null doc_id has the noise of the empty string and comes last among ties; repeated
rows and ids count, are scored and are drawn each on its own; equal scores and ids go by fewer features, then smaller
weight, then place in the table; an empty target makes all buckets' gains those of the smoothing alone; an empty table
gives an empty result; other columns are not read, and ``resample`` keeps them whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.llm.common import Rows, cut, free_name, scratch, sql_words, text_of

BUCKETS, SEED, MAX_N, MIN_WORDS, PERCENT = 10_000, 2024, 1, 20, 10
PLACE_BITS = 33  # of monotonically_increasing_id


def features(words: Column, max_n: int = MAX_N) -> Column:
    """All runs of 1 to ``max_n`` consecutive words, joined by one space, as an array."""
    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return words if max_n == 1 else F.concat(words, *map(runs, range(2, max_n + 1)))


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: Column, docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of ``docs``; buckets without features have no row."""
    words = docs.select(sql_words(text_of(texts)).alias("words"))
    found = words.select(F.explode(features(F.col("words"), max_n)).alias("feature"))
    return found.groupBy(bucket_of(F.col("feature"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: thousandths of the log ratio of target and raw frequencies, add-one smoothed."""
    all_raw, all_target = ((counts.agg(F.sum("n")).first()[0] or 0) for counts in (raw, target))  # two numbers
    one = lambda counts, name: counts.select("bucket", F.col("n").cast("double").alias(name))
    both = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(one(raw, "s"), "bucket", "left").join(one(target, "t"), "bucket", "left").fillna(0.0)
    up, down = (F.col("t") + 1.0) * F.lit(float(all_raw + buckets)), (F.col("s") + 1.0) * F.lit(float(all_target + buckets))
    return both.select("bucket", F.floor(1000.0 * F.ln(up / down)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate that hangs on seed and id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def weighed(rows: Rows, gain: DataFrame, text: str, doc_id: str, max_n: int, buckets: int) -> DataFrame:
    """Per document: row, doc_id, n_words, n_features, weight. ``gain`` has a row for each bucket and is broadcast."""
    row = free_name(rows.docs, "drawn_row")
    picked = rows.numbered(row).select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), sql_words(text_of(F.col(text))).alias("words"))
    found = picked.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(features(F.col("words"), max_n)).alias("feature"))
    placed = found.withColumn("bucket", bucket_of(F.col("feature"), buckets)).join(F.broadcast(gain), "bucket", "left")
    return placed.groupBy("row", "doc_id", "n_words").agg(F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scored`` (written) with the rank of the rows that are drawn, by a sort over range partitions and their offsets."""
    n = scored.where(F.col("n_words") >= min_words).count()
    drawn = percent * n // 100
    short = F.col("n_words") < min_words
    order = (short, F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row"))
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = cut(placed.select("*", F.shiftright(at, PLACE_BITS).alias("part"), at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size")).orderBy("part").collect()  # a row for each partition
    before = accumulate((r["size"] for r in sizes), initial=0)
    offsets = scored.sparkSession.createDataFrame([(r.part, b) for r, b in zip(sizes, before, strict=False)], "part long, before long")
    rank = F.col("place") + F.col("before") + 1
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.when(~short & (rank <= drawn), rank)).drop("part", "place", "before")


def importance_ranks(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
    max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per document: row, doc_id, n_words, n_features, weight, score, rank (null if not drawn).

    ``row`` is the number that ``common.Rows`` gives the document's row.
    """
    return _ranks(Rows(docs), target, text, doc_id, target_text, max_n, buckets, min_words, percent, seed)


def _ranks(rows: Rows, target: DataFrame, text: str, doc_id: str, target_text: str, max_n: int, buckets: int, min_words: int, percent: int, seed: int) -> DataFrame:
    spark = target.sparkSession
    with scratch(spark) as made:
        gain = cut(gains(cut(bucket_counts(F.col(text), rows.docs, max_n, buckets)), cut(bucket_counts(F.col(target_text), target, max_n, buckets)), buckets))
        scored = cut(weighed(rows, gain, text, doc_id, max_n, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
        out = cut(ranked(scored, percent, min_words))
        made.keep(out)
    return out


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text",
    max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Their texts never shuffle (``common.Rows``)."""
    rows = Rows(docs)
    found = _ranks(rows, target, text, doc_id, target_text, max_n, buckets, min_words, percent, seed)
    return rows.pick(found.where("rank is not null").select("row"), keep=True)


def resample_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank, with the default parameters."""
    return importance_ranks(docs, target).select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


#: crc32 comes from its definition, once for each distinct word.
REPORT_SQL = rf"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
both_tables AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
d AS (SELECT kind, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM both_tables),
f AS (SELECT kind, r, unnest(words) AS word FROM d),
u AS (SELECT DISTINCT word FROM f),
b AS (SELECT word, xor(4294967295, list_reduce(list_concat([4294967295],
        list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % {BUCKETS} AS bucket FROM u, tab),
p AS (SELECT kind, r, bucket FROM f JOIN b USING (word)),
n AS (SELECT range AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range({BUCKETS})
      LEFT JOIN (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM p GROUP BY bucket) c ON c.bucket = range),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
g AS (SELECT bucket, floor(1000 * ln((n.t + 1)::DOUBLE * (z.s + {BUCKETS})::DOUBLE / ((n.s + 1)::DOUBLE * (z.t + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM n, z),
w AS (SELECT r, sum(gain)::BIGINT AS weight FROM p JOIN g USING (bucket) WHERE kind = 0 GROUP BY r),
o AS (SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r) WHERE kind = 0),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight, r) AS place FROM s)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * (SELECT count(*) FROM s WHERE n_features >= {MIN_WORDS}) // 100 THEN place END AS rank FROM k
"""
