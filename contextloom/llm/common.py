"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from contextloom import session
from contextloom.storage import cut, release, scratch

__all__ = ["byte_lists", "cut", "free_name", "release", "scratch", "ship", "spaced_words", "table", "text_of", "words_of"]

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
WHITE = r"[\x20\x09-\x0D]+"
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII; A-Z become a-z, the rest a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: A-Z become a-z, the white space characters a space, the rest stays.
SPACE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and send them whole texts in batches smaller than Spark's default.

    The batches bound a worker's memory.
    """
    session.ship(spark)
    if int(spark.conf.get(BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a variant of it, that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish = "_" + wish
    return wish


def quoted(names: Sequence[str]) -> list[Column]:
    """Columns by their names as they are, dots and backticks included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


# ---- rows of a table by their lasting numbers ----
FILE_BITS = 33  # a row's number is that of its file << FILE_BITS | its place there
CELL_BITS = 15  # bits of one bitmap of bitmap_construct_agg
MAX_FILES = 2_000_000  # whose numbers go by broadcast, 16 bytes each; those of more meet their rows in a shuffle
MAX_BITMAPS = 16_384  # 4 KB each: 64 MB in a broadcast


def bit_is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (byte / F.pow(F.lit(2.0), bit % 8)).cast("int") % 2 == 1


class Rows:
    """The rows of ``docs`` under numbers that every reading gives alike: that of the Parquet file and the place in it.

    How a file is split, which executors there are and what is retried don't matter. What isn't a plain scan of Parquet
    files is written once and read from there. Rows chosen by number are found by bitmaps, a bit for each row, which go
    to the rows by broadcast: texts never shuffle. Files are taken in groups whose bitmaps number at most
    ``max_bitmaps``; beyond one group, each writes its rows before the next one starts.
    """

    def __init__(self, docs: DataFrame, max_bitmaps: int = MAX_BITMAPS):
        self.docs = docs if is_scan(docs) else cut(docs)
        self.columns, self.max_bitmaps = docs.columns, max_bitmaps
        paths = self.docs.select(self._place("file_path").alias("path")).distinct()
        number = F.row_number().over(Window.orderBy("path")).cast("long")  # a row for each file
        self.files = cut(paths.select("path", F.xxhash64("path").alias("hash"), number.alias("file")))
        n, apart = self.files.agg(F.count(F.lit(1)), F.countDistinct("hash")).first()
        self.by_hash, self.few = n == apart, n <= MAX_FILES

    def _place(self, field: str) -> Column:
        return self.docs.metadataColumn("_metadata")[field]

    def numbered(self, name: str, paths: list[str] | None = None) -> DataFrame:
        """All columns of the rows and their number, which has a name that no column has."""
        path, place = free_name(self.docs, "file_of_row"), free_name(self.docs, "place_of_row")
        docs = self.docs if paths is None else self.docs.where(self._place("file_path").isin(paths))
        own = self._place("file_path")
        rows = docs.select("*", (F.xxhash64(own) if self.by_hash else own).alias(path), self._place("row_index").alias(place))
        files = self.files.select(F.col("hash" if self.by_hash else "path").alias(path), F.shiftleft("file", FILE_BITS).alias(name))
        return rows.join(F.broadcast(files) if self.few else files, path).withColumn(name, F.col(name) + F.col(place)).select(*quoted(self.columns), name)

    def pick(self, numbers: DataFrame, keep: bool, name: str | None = None) -> DataFrame:
        """The rows whose number ``numbers`` (one column) has, or has not; those it has with their number if ``name`` is given."""
        (number,) = numbers.columns
        cell, bits = free_name(self.docs, "cell_of_row"), free_name(self.docs, "bits_of_row")
        placed = numbers.select(F.shiftright(number, CELL_BITS).alias(cell), F.col(number).bitwiseAND(F.lit((1 << CELL_BITS) - 1)).alias("bit"))
        bitmaps = cut(placed.groupBy(cell).agg(F.bitmap_construct_agg("bit").alias(bits)))

        def part(chosen: DataFrame, paths: list[str] | None) -> DataFrame:
            """Rows meet the bitmap of their file and cell in one join, which only those chosen come out of."""
            path, place, marked, first = (free_name(self.docs, n) for n in ("file_of_row", "place_of_row", "file_of_mark", "first_of_mark"))
            docs = self.docs if paths is None else self.docs.where(self._place("file_path").isin(paths))
            file_path = self._place("file_path")
            rows = docs.select("*", (F.xxhash64(file_path) if self.by_hash else file_path).alias(path), self._place("row_index").alias(place))
            files = self.files.select("file", F.col("hash" if self.by_hash else "path").alias(marked))
            marks = chosen.join(files, F.shiftright(cell, FILE_BITS - CELL_BITS) == F.col("file"))
            marks = marks.select(marked, F.shiftleft("file", FILE_BITS).alias(first), F.col(cell).bitwiseAND(F.lit((1 << (FILE_BITS - CELL_BITS)) - 1)).alias(cell), bits)
            met = (F.col(path) == F.col(marked)) & (F.shiftright(place, CELL_BITS) == F.col(cell)) & bit_is_set(F.col(bits), F.col(place).bitwiseAND(F.lit((1 << CELL_BITS) - 1)))
            out = rows.join(F.broadcast(marks), met, "inner" if keep else "left_anti")
            return out.select(*quoted(self.columns), *([(F.col(first) + F.col(place)).alias(name)] if name else []))

        if bitmaps.count() <= self.max_bitmaps:
            return part(bitmaps, None)
        file = F.shiftright(cell, FILE_BITS - CELL_BITS)
        sizes = bitmaps.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n"))
        listed = self.files.join(sizes, "file", "left").select("path", "file", F.coalesce("n", F.lit(0)).alias("n")).orderBy("file").collect()  # a row for each file
        groups: list[list] = [[]]
        held = 0
        for f in listed:
            if groups[-1] and held + f.n > self.max_bitmaps:
                groups.append([])
                held = 0
            groups[-1].append(f)
            held += f.n
        out = None
        for g in groups:
            mine = bitmaps.where(file.between(g[0].file, g[-1].file))
            written = cut(part(mine, [f.path for f in g]))
            out = written if out is None else out.unionByName(written)
        return out


def with_numbers(rows: DataFrame, number: str, numbers: DataFrame, max_bitmaps: int = MAX_BITMAPS) -> DataFrame:
    """The rows of a written table whose ``number`` is one of ``numbers`` (one column); nothing of them shuffles unless bitmaps are too many."""
    (one,) = numbers.columns
    cell, bits = free_name(rows, "cell_of_number"), free_name(rows, "bits_of_number")
    mask = F.lit((1 << CELL_BITS) - 1)
    placed = numbers.select(F.shiftright(one, CELL_BITS).alias(cell), F.col(one).bitwiseAND(mask).alias("bit"))
    bitmaps = cut(placed.groupBy(cell).agg(F.bitmap_construct_agg("bit").alias(bits)))
    if bitmaps.count() > max_bitmaps:
        return rows.join(numbers.select(F.col(one).alias(number)), number, "left_semi")
    hit = bit_is_set(F.col(bits), F.col(number).bitwiseAND(mask))
    return rows.withColumn(cell, F.shiftright(number, CELL_BITS)).join(F.broadcast(bitmaps), cell).where(hit).select(*quoted(rows.columns))


def is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` reads Parquet files as they are."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":  # type: ignore[attr-defined]
        return False
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return False
    return True


def byte_lists(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(WORD_BYTES).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return [w for w in text.translate(SPACE_BYTES).split(b" ") if w] if text else []


def sql_words(text: Column) -> Column:
    """``words_of`` as a column: an array without empty strings."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    flat = F.btrim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])
