"""Contexts and prompts of made questions against their SQL."""

from __future__ import annotations

import os

import pytest
from oracle import duck_rows, rows_of
from pyspark.sql import functions as F

from contextloom.operators import rag as R
from contextloom.operators import vectors as V
from contextloom.plans import retrieval


@pytest.fixture(scope="module")
def asked(spark, small, tmp_path_factory) -> str:
    """Documents of 16 words that share 1, 5, 7, 9 and 13 words with the first question: scores of 0.0625, 0.3125, 0.4375, 0.5625 and 0.8125.

    The second one shares a word with one document only, the others have no words.
    """
    d = tmp_path_factory.mktemp("asked")
    bucket, words = V.BucketOf(retrieval.DIM), {}
    for i in range(1000):
        words.setdefault(bucket[f"w{i}"], f"w{i}")
    words = list(words.values())
    rows = [(i, " ".join(words[16 - n : 32 - n]), "en", "web", 0) for i, n in enumerate((1, 5, 7, 9, 13))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(d / "documents.parquet")
    spark.createDataFrame([(1, " ".join(words[:16])), (2, words[3]), (3, " \n"), (4, ""), (5, None)], "item_id long, text string").toPandas().to_parquet(d / "benchmark.parquet")
    for name in os.listdir(small):
        if not (d / name).exists():
            os.symlink(f"{small}/{name}", d / name)
    return str(d)


def test_three_places_as_printf_has_them(spark):
    """Halves that a number doesn't quite reach, or that go to the even digit, aren't rounded up."""
    x = [0.1235, 0.0625, 0.3125, 0.5625, 0.1875, 0.4045, 0.0005, 0.00049, 0.0, 1.0, -0.1235, -0.0001, 12.0625, 1234567.8125, *(i / 2000 for i in range(2001))]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", R.three_places(F.col("x")).alias("t"))
    assert {r.i: r.t for r in got.collect()} == {i: f"{v:.3f}" for i, v in enumerate(x)}
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),)], "x double").select(R.context_line(F.lit(1), F.lit("f"), F.lit("u"), F.col("x"), F.lit("t")).alias("t"))
    assert {r.t for r in odd.collect()} == {"[SOURCE 1 | f | score: NaN]\nt", "[SOURCE 1 | f | score: Infinity]\nt"}


def test_contexts_with_halves_in_their_scores(spark, asked):
    assert "score: 0.562]" in retrieval.formatted_contexts(spark, asked).where("query_id = 1").first().contexts
    assert rows_of(retrieval.rag_format_contexts(spark, asked)) == duck_rows(retrieval.SQL["rag_format_contexts"], asked)[1]


def test_prompts_with_halves_in_their_scores_and_without_hits(spark, asked):
    prompt = {r.query_id: r.prompt for r in retrieval.prompts(spark, asked).collect()}
    assert "score: 0.312]" in prompt[1] and "[SOURCE 2" not in prompt[2]
    assert all(R.NO_CONTEXTS in prompt[i] for i in (3, 4, 5))
    assert rows_of(retrieval.rag_prompt(spark, asked)) == duck_rows(retrieval.SQL["rag_prompt"], asked)[1]


@pytest.mark.parametrize("name", ["semantic_search", "rag_contexts", "rag_format_contexts"])
def test_hits_share_a_word_with_their_question(spark, asked, name):
    assert rows_of(getattr(retrieval, name)(spark, asked)) == duck_rows(retrieval.SQL[name], asked)[1]
