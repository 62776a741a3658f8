"""The library in a few calls: ingest files, search, answer, chat, read pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.operators import chunking, rag
from contextloom.operators.registry import Embedder, embedded
from contextloom.operators.vectors import VectorIndex
from contextloom.sources.files import ScanOptions, read_files

LIMITS = {"query": (1, 10_000), "max_tokens": (1, 4096), "top_k": (1, 100), "timeout": (1, 300), "num_results": (1, 50), "temperature": (0, 2)}


def validated(**values: float | str) -> None:
    """Raise for a value (or the length of a text) outside its limits."""
    for name, value in values.items():
        low, high = LIMITS[name]
        if not low <= (len(value) if isinstance(value, str) else value) <= high:
            raise ValueError(f"{name} must be within {low} and {high}")


@dataclass(frozen=True)
class Ingested:
    files: int
    chunks: int
    indexed: int


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks with ids; blank ones keep their number and are left out, files that failed give their error."""
    chunks = chunking.chunked(files)
    return chunks.withColumn("chunk_id", chunking.chunk_id(F.col("path"), F.col("idx"), F.col("text")))


def ingest(spark: SparkSession, options: ScanOptions, index: VectorIndex, embedder: Embedder | None = None, dim: int = 256, dedup: bool = False) -> Ingested:
    """Scan, chunk, embed and append to the index. Counts come from the written rows."""
    chunks = chunk_files(read_files(spark, options)).where("error is null")
    vectors = embedded(chunks.where("text <> ''").dropDuplicates(["chunk_id"]), "chunk_id", "text", embedder, dim)
    rows = chunks.join(vectors, "chunk_id").withColumn("source", F.lit("file"))
    stats = chunks.agg(F.countDistinct("path").alias("f"), F.count(F.lit(1)).alias("c")).first()
    return Ingested(stats.f, stats.c, index.insert(rows, dedup))


def search(index: VectorIndex, queries: DataFrame, k: int = 10, embedder: Embedder | None = None, dim: int = 256) -> DataFrame:
    """Hits of text queries (query_id, question)."""
    validated(top_k=k)
    vectors = embedded(queries, "query_id", "question", embedder, dim)
    return index.search(vectors, k)


def prompts(index: VectorIndex, questions: DataFrame, embedder: Embedder | None = None, dim: int = 256) -> DataFrame:
    """(query_id, question, contexts, prompt): the best five of ten hits for each question."""
    hits = rag.kept_contexts(search(index, questions, 10, embedder, dim), "query_id")
    line = rag.context_line(F.col("place"), F.col("meta.file_path"), F.lit(None).cast("string"), F.col("score"), F.col("text"))
    contexts = hits.select("query_id", "place", line.alias("line")).groupBy("query_id").agg(rag.joined_lines("place", "line").alias("contexts"))
    rows = questions.select("query_id", "question").join(contexts, "query_id", "left")
    return rows.withColumn("prompt", rag.prompt(F.col("question"), F.col("contexts"), F.lit("")))


def answer(index: VectorIndex, questions: DataFrame, embedder: Embedder | None = None, dim: int = 256) -> DataFrame:
    """Deterministic answers: the first sentence of the best context, cited."""
    return prompts(index, questions, embedder, dim).withColumn("answer", rag.extractive_answer(F.col("contexts")))


def views(spark: SparkSession, **frames: DataFrame) -> None:
    """Name frames (chunks, index, tasks, agents, ...) for ``spark.sql``."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
