"""Fetched pages: cache, search results, text."""

from __future__ import annotations

import html as html_lib
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextloom.operators.asof import asof_join

CACHE_HOURS = 24
MAX_PAGE = 1 << 20


def cache_key(url: Column) -> Column:
    return F.md5(url)


def latest_cached(cache: DataFrame) -> DataFrame:
    """One row per key: the last write."""
    rest = [c for c in cache.columns if c not in ("key", "fetched_at")]
    rows = cache.groupBy("key").agg(F.max_by(F.struct("fetched_at", *rest), "fetched_at").alias("r"))
    return rows.select("key", "r.*")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, hours: int = CACHE_HOURS) -> DataFrame:
    """Requests (url) with hit: whether the cache has the page and it is younger than ``hours``."""
    kept = latest_cached(cache).select("key", "fetched_at")
    rows = requests.withColumn("key", cache_key(F.col("url"))).join(kept, "key", "left")
    age = now.cast("timestamp").cast("long") - F.col("fetched_at").cast("timestamp").cast("long")
    return rows.withColumn("hit", F.coalesce(age < hours * 3600, F.lit(False)))


def cache_as_of(requests: DataFrame, writes: DataFrame, at: str = "at", hours: int = CACHE_HOURS, columns: Sequence[str] = ("fetched_at",)) -> DataFrame:
    """Requests (url, at) as they would have met the cache at their own time, which ``writes`` (key, fetched_at, ...) filled: with
    hit, and the columns of the write that they met. A page is forgotten ``hours`` after its last write."""
    asked = requests.withColumn("key", cache_key(F.col("url")))
    met = asof_join(asked, writes, "key", at, "fetched_at", columns, hours)
    return met.withColumn("hit", F.col(columns[0]).isNotNull()).drop("key")


def cache_stats(cache: DataFrame, size: str = "size") -> DataFrame:
    total = F.coalesce(F.sum(size), F.lit(0))
    return cache.agg(F.count(F.lit(1)).alias("entries"), total.alias("bytes"), F.round(total / (1 << 20), 2).alias("megabytes"))


def without_url(cache: DataFrame, url: str) -> DataFrame:
    return cache.where(F.col("key") != F.md5(F.lit(url)))


def normalised_results(provider: str, rows: DataFrame, title: str, snippet: str, url: str, most: int | None = None, by: str = "query_id", order: str = "position") -> DataFrame:
    """A provider's results as query_id, position, title, snippet, url, source; null fields become empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = rows.select(by, order, text(title).alias("title"), text(snippet).alias("snippet"), text(url).alias("url"), F.lit(provider).alias("source"))
    return out.where(F.col(order) <= most) if most is not None else out


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.silent = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.silent += tag in ("script", "style")
        self.in_title |= tag == "title"

    def handle_endtag(self, tag: str) -> None:
        self.silent -= tag in ("script", "style") and self.silent > 0
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.in_title:
                self.title.append(data)


def parsed_page(page: str | None) -> tuple[str, str]:
    """(title, text): all text but scripts and styles, in one line."""
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    phrases = (p.strip() for line in "".join(parser.parts).splitlines() for p in line.strip().split("  "))
    return html_lib.unescape("".join(parser.title)).strip(), " ".join(p for p in phrases if p)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())]))
def page_text(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        yield pd.DataFrame([parsed_page(p) for p in batch], columns=["title", "content"])


def fetched(pages: DataFrame, html: str = "html", max_bytes: int | None = MAX_PAGE, max_chars: int | None = None) -> DataFrame:
    """Pages within the size limit (all, null ones too, without one) with title, content (cut at ``max_chars``) and content_length."""
    rows = pages if max_bytes is None else pages.where(F.octet_length(html) <= max_bytes)
    rows = rows.withColumn("_p", page_text(F.col(html)))
    content = F.col("_p.content")
    if max_chars is not None:
        content = F.when(F.length(content) > max_chars, F.concat(F.substring(content, 1, max_chars), F.lit("..."))).otherwise(content)
    rows = rows.withColumn("title", F.col("_p.title")).withColumn("content", content)
    return rows.withColumn("content_length", F.length("content")).drop("_p")
