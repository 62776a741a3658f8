"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

1. quality: documents that the hierarchical classifier finds poor or toxic go;
2. exact: of equal texts the one with the smallest doc_id stays;
3. near: of each component of near copies the one with the smallest doc_id stays;
4. benchmark: documents in which a window of a benchmark item occurs go;
5. packing: what is left is packed into sequences; the result has a row for each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contextloom.llm import decontaminate, exact_dedup, ngram_jaccard, packing, quality
from contextloom.llm.common import cut, release, scratch, table
from contextloom.llm.queries import added_tokens, vocabulary


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, *vocabulary(), added=added_tokens())


STAGES = [
    ("quality", drop_poor),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("packing", pack),
]

#: A trained classifier and a genetic algorithm are no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written to the shared folder and read again.

    Once it is written, what the stage read and wrote on the way is deleted, so the folder holds one stage at a time.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as made:
            done = cut(stage(spark, docs, sf_dir))
            made.keep(done)
        release(docs)
        docs = done
    return docs
