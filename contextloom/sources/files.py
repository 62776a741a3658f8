"""File trees, listings and uploads as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextloom.functions.text import file_extension, glob_regex, mime_allowed
from contextloom.storage import cut

# What is read and what is left out by default.
INCLUDE = "*.py *.js *.jsx *.ts *.tsx *.md *.markdown *.txt *.json *.yaml *.yml *.toml *.cfg *.ini".split()
EXCLUDE = (
    "*.pyc *.pyo *.pyd __pycache__/* *.so *.dylib *.dll .git/* .svn/* .hg/* .bzr/* node_modules/* venv/* env/* .env/* "
    "virtualenv/* *.log *.tmp *.temp *.cache .DS_Store Thumbs.db *.min.js *.min.css dist/* build/* target/* out/* *.env* "
    "*.key *.pem *secret* *password* *.zip *.tar *.gz *.rar *.7z *.jpg *.jpeg *.png *.gif *.bmp *.svg *.ico *.mp3 *.mp4 "
    "*.avi *.mov *.wmv *.flv *.pdf *.doc *.docx *.xls *.xlsx *.ppt *.pptx"
).split()
MAX_SIZE, MAX_FILES = 1 << 20, 10_000
MAX_UPLOAD = 50 << 20
ENCODINGS = ("utf-8", "utf-16", "latin-1")


@dataclass(frozen=True)
class ScanOptions:
    path: str
    recursive: bool = True
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    max_file_size: int = MAX_SIZE
    max_files: int | None = MAX_FILES

    def __post_init__(self) -> None:
        if ".." in self.path.split("/"):
            raise ValueError("a path must not climb")
        if self.max_file_size < 1 or (self.max_files is not None and self.max_files < 1):
            raise ValueError("limits must be positive")


def kept_path(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a relative path is read: a given list takes the default's place, an empty one does not."""
    return path.rlike(glob_regex(list(include) or INCLUDE)) & ~path.rlike(glob_regex(list(exclude) or EXCLUDE))


def raw_files(spark: SparkSession, options: ScanOptions) -> DataFrame:
    """Files below a path that patterns and size keep; the content is read only if a later step asks for it."""
    rows = found_files(spark, options)
    return rows.where((F.col("length") <= options.max_file_size) & kept_path(F.col("path"), options.include, options.exclude))


def found_files(spark: SparkSession, options: ScanOptions, forgiving: bool = False) -> DataFrame:
    """All files below a path, by their relative paths; ``forgiving`` leaves out those that can't be read when their content is."""
    root = options.path.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(options.recursive).lower())
    if forgiving:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), "^" + "".join(f"\\{c}" if not c.isalnum() else c for c in root) + "/+", "")
    rows = reader.load(root if options.recursive else f"{root}/*").withColumn("path", relative)
    if not options.recursive:
        rows = rows.where(~F.col("path").contains("/"))
    return rows


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decode(content: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Text by the first encoding that fits; line ends become newlines."""
    for batch in content:
        out = []
        for raw in batch:
            for name in ENCODINGS:
                try:
                    out.append((bytes(raw).decode(name).replace("\r\n", "\n").replace("\r", "\n"), name))
                    break
                except (UnicodeError, TypeError):
                    continue
            else:
                out.append((None, None))
        yield pd.DataFrame(out, columns=["text", "encoding"])


def read_files(spark: SparkSession, options: ScanOptions) -> DataFrame:
    """path, content, size, modified_time, encoding; unreadable files are left out, the first ``max_files`` by path stay.

    The first ones are found among names, written, and their contents read afterwards: a few more than ``max_files`` only
    if some of them turn out unreadable.
    """
    rows = raw_files(spark, options)
    if options.max_files is not None:
        listed = cut(rows.select("path").orderBy("path").limit(options.max_files))
        found = decoded(rows.join(F.broadcast(listed), "path"))
        if listed.count() == options.max_files and (short := options.max_files - found.count()):
            last = listed.agg(F.max("path")).first()[0]
            more = decoded(rows.where(F.col("path") > last)).orderBy("path").limit(short)
            return found.unionByName(more)
        return found
    return decoded(rows)


# What becomes of a file in a scan.
PROCESSED, BY_NAME, BY_SIZE, BY_LIMIT, FAILED = "processed", "name", "size", "limit", "error"


def scan_outcomes(spark: SparkSession, options: ScanOptions) -> DataFrame:
    """(path, size, outcome, error): a row for each file that a scan finds, and what becomes of it.

    ``name`` and ``size`` are left out by pattern and limit; of the others the first ``max_files`` by path are processed or have an
    error, the rest are beyond the ``limit``. A file that can't be read, or that no encoding fits, is its own error and hurts no
    other. Only contents of files that may be processed are read.
    """
    listed = cut(found_files(spark, options).select("path", F.col("length").alias("size")))
    named, fits = kept_path(F.col("path"), options.include, options.exclude), F.col("size") <= options.max_file_size
    able = listed.where(named & fits)
    if options.max_files is not None:
        able = able.orderBy("path").limit(options.max_files)
    able = cut(able.select("path"))
    small = options.max_files is not None  # then it is a bounded list
    rows = found_files(spark, options, forgiving=True).where((F.col("length") <= options.max_file_size) & kept_path(F.col("path"), options.include, options.exclude))
    read = rows.join(F.broadcast(able) if small else able, "path").select("path", decode("content").alias("d"))
    read = cut(read.select("path", F.col("d.text").isNotNull().alias("decoded")))
    met = listed.join(able.withColumn("able", F.lit(True)), "path", "left").join(read, "path", "left")
    wrong = F.when(F.col("decoded").isNull(), F.concat(F.lit("Error processing "), F.col("path"), F.lit(": it can't be read")))
    wrong = wrong.when(~F.col("decoded"), F.concat(F.lit("Error processing "), F.col("path"), F.lit(": no encoding fits")))
    outcome = F.when(~named, BY_NAME).when(~fits, BY_SIZE).when(F.col("able").isNull(), BY_LIMIT).when(F.coalesce("decoded", F.lit(False)), PROCESSED).otherwise(FAILED)
    return met.select("path", "size", outcome.alias("outcome"), F.when(F.col("able"), wrong).alias("error"))


def scan_totals(outcomes: DataFrame) -> DataFrame:
    """Files found, processed and skipped, bytes of the processed ones, and errors: one row."""
    done = F.col("outcome") == PROCESSED
    return outcomes.agg(
        F.count(F.lit(1)).alias("found"), F.count_if(done).alias("processed"), F.count_if(~done).alias("skipped"),
        F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("bytes"), F.count("error").alias("errors"),
    )


def decoded(rows: DataFrame) -> DataFrame:
    out = rows.select("path", decode("content").alias("d"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_time"))
    return out.where("d.text is not null").select("path", F.col("d.text").alias("content"), "size", "modified_time", F.col("d.encoding").alias("encoding"))


def list_files(spark: SparkSession, options: ScanOptions) -> DataFrame:
    """The same files without content, which is then never read."""
    return raw_files(spark, options).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_time"), file_extension(F.col("path")).alias("extension"))


def scan_stats(files: DataFrame, kept: Column, size: str = "size", by: Sequence[str] = ()) -> DataFrame:
    """Found, processed and skipped files, and the bytes of the processed ones."""
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(kept).alias("processed"), F.count_if(~kept).alias("skipped"),
        F.coalesce(F.sum(F.when(kept, F.col(size))), F.lit(0)).alias("bytes"),
    )


# ---- uploads ----
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """Paragraphs of a word-processor file, by the standard library; empty on error."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError):
        return ""
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD_XML}t")) for p in root.iter(f"{WORD_XML}p")).strip()


def pdf_text(raw: bytes) -> str:
    """Text of a PDF if a reader is installed, else empty."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return ""
    try:
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages).strip()
    except Exception:  # a reader fails in many ways on broken files; each means no text
        return ""


def image_facts(raw: bytes) -> str:
    """Format and size of an image from its header: PNG, GIF, BMP and JPEG."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return f"png {int.from_bytes(raw[16:20], 'big')}x{int.from_bytes(raw[20:24], 'big')}"
    if raw[:3] == b"GIF":
        return f"gif {int.from_bytes(raw[6:8], 'little')}x{int.from_bytes(raw[8:10], 'little')}"
    if raw[:2] == b"BM":
        return f"bmp {int.from_bytes(raw[18:22], 'little')}x{int.from_bytes(raw[22:26], 'little')}"
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 < len(raw) and raw[at] == 0xFF:
        if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            return f"jpeg {int.from_bytes(raw[at + 7 : at + 9], 'big')}x{int.from_bytes(raw[at + 5 : at + 7], 'big')}"
        at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return ""


Tier = Callable[[bytes], Mapping[str, float]]


def image_description(tiers: Sequence[Tier] = (), top: int = 3) -> Callable[[Column], Column]:
    """A column function that describes images: their header's facts and the ``top`` labels of the first tier that answers.

    A tier is a model: it takes an image's bytes and gives probabilities of labels; one that fails or knows nothing passes
    the image on to the next. Without any answer the facts alone describe it; what is no image has no description.
    """
    chosen = list(tiers)

    @F.pandas_udf(T.StringType())
    def describe(content: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> str | None:
            if raw is None or not (facts := image_facts(bytes(raw))):
                return None
            for tier in chosen:
                try:
                    found = sorted(tier(bytes(raw)).items(), key=lambda x: (-x[1], x[0]))[:top]
                except Exception:  # a model may fail in any way; the next one is asked
                    continue
                if found:
                    return f"{facts}: " + ", ".join(f"{label} ({p:.1%})" for label, p in found)
            return facts

        return pd.Series([one(r) for r in content], dtype=object)

    return describe


@F.pandas_udf(T.StringType())
def upload_text(content: pd.Series, mime: pd.Series) -> pd.Series:
    def one(raw: bytes | None, kind: str | None) -> str | None:
        if raw is None or kind is None:
            return None
        raw = bytes(raw)
        if kind == "application/pdf":
            return pdf_text(raw)
        if kind == DOCX:
            return docx_text(raw)
        if kind.startswith("image/"):
            return image_facts(raw)
        return raw.decode("utf-8", "replace") if kind.startswith("text/") or kind == "application/json" else None

    return pd.Series([one(r, k) for r, k in zip(content, mime, strict=True)], dtype=object)


def uploads(files: DataFrame, content: str = "content", mime: str = "mime", allowed: Sequence[str] = ("text/*", "image/*", "application/pdf", "application/json", DOCX),
            image_tiers: Sequence[Tier] = ()) -> DataFrame:
    """Uploaded files with id, base64 data and extracted text; what is too large or of another type is left out.

    Images are described by the ``image_tiers``, in their order.
    """
    rows = files.where((F.octet_length(content) <= MAX_UPLOAD) & mime_allowed(F.col(mime), allowed))
    return rows.withColumns({
        "id": F.concat(F.lit("file_"), F.substring(F.md5(content), 1, 8)), "size": F.octet_length(content),
        "data": F.base64(content),
        "extracted_text": F.when(F.col(mime).startswith("image/"), F.coalesce(image_description(image_tiers)(F.col(content)), F.lit(""))).otherwise(upload_text(F.col(content), F.col(mime))),
    })
