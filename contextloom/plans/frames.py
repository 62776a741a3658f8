"""Frames of the library's tables made from the driver's, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.session import ship

EXTENSIONS = (".py", ".js", ".md", ".txt", ".tsx", ".png")
CAPABILITIES = ("code", "files", "search")
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def bits(n: Column, words: tuple[str, ...] = CAPABILITIES) -> Column:
    """The words whose bits are set in n."""
    return F.filter(F.array(*map(F.lit, words)), lambda x, i: F.floor(n / F.pow(F.lit(2.0), i)) % 2 == 1)


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: path, content, size."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    return table(spark, d, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("text").alias("content"),
        F.octet_length("text").cast("long").alias("size"), "source", "lang",
    )


FILES = """files AS (SELECT doc_id, source || '/' || doc_id || (['.py','.js','.md','.txt','.tsx','.png'])[doc_id % 6 + 1] AS path,
  text AS content, strlen(text) AS size, source, lang FROM documents)"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    first, status = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.when(first == "1", 20).when(first == "2", 10).when(first == "3", 5).otherwise(1).alias("priority"),
        F.when(status == "O", "queued").when(status == "P", "running").otherwise("completed").alias("status"),
        F.col("o_orderdate").alias("created_at"), bits(F.col("o_orderkey") % 8).alias("required_capabilities"), F.col("o_custkey").alias("owner"),
    )


TASKS = """tasks AS (SELECT o_orderkey AS task_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 20 WHEN '2' THEN 10 WHEN '3' THEN 5 ELSE 1 END AS priority,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS created_at,
  list_filter(['code','files','search'], lambda x, i: (o_orderkey % 8) // (1 << (i - 1)) % 2 = 1) AS required_capabilities, o_custkey AS owner FROM orders)"""


def agents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("agent_id"), bits(F.col("s_nationkey") % 8).alias("capabilities"),
        F.element_at(F.array(*map(F.lit, ("offline", "online", "online", "busy"))), (k % 4 + 1).cast("int")).alias("status"),
        (k % 7).cast("int").alias("current_tasks"), F.lit(5).alias("max_concurrent_tasks"), (k * 37 % 1009).alias("registered_at"),
    )


AGENTS = """agents AS (SELECT s_suppkey AS agent_id, list_filter(['code','files','search'], lambda x, i: (s_nationkey % 8) // (1 << (i - 1)) % 2 = 1) AS capabilities,
  (['offline','online','online','busy'])[s_suppkey % 4 + 1] AS status, (s_suppkey % 7)::INT AS current_tasks, 5 AS max_concurrent_tasks, s_suppkey * 37 % 1009 AS registered_at FROM supplier)"""


def cache(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a cache: the later the page, the older its copy."""
    now = F.lit(NOW).cast("timestamp_ntz")
    return table(spark, d, "pages").select(
        F.md5("url").alias("key"), "url", (now - F.make_interval(mins=F.col("page_id").cast("int") * 17)).alias("fetched_at"),
        F.octet_length("html").cast("long").alias("size"), "page_id",
    )


CACHE = f"""cache AS (SELECT md5(url) AS key, url, TIMESTAMP '{NOW}' - (page_id * 17) * INTERVAL 1 MINUTE AS fetched_at, strlen(html) AS size, page_id FROM pages)"""


def sql(*ctes: str, body: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
