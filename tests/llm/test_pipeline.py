"""Each stage of the pipeline against a brute-force version of its own input."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest

from contextloom.llm import decontaminate, ngram_jaccard
from contextloom.llm.common import cut, table


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = table(spark, small, "documents"), {}
    out["start"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = cut(stage(spark, docs, small))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["start", "quality", "exact", "near", "benchmark", "packing"]
    for name in ("quality", "exact", "near", "benchmark"):
        assert stages[name].columns == stages["start"].columns


def test_quality_keeps_clean_documents(spark, small, stages):
    kept = texts(stages["quality"])
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, small, "labels").collect()}
    clean = [i for i, x in labels.items() if x == (1, 0)]
    bad = [i for i, x in labels.items() if x[0] == 0 or x[1] == 1]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert sum(i not in kept for i in bad) >= 0.6 * len(bad)  # some dozen labels to learn from


def test_exact(stages):
    before, first = texts(stages["quality"]), {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]), i)
    assert set(texts(stages["exact"])) == set(first.values())


def test_near(stages):
    before = texts(stages["exact"])
    rows = ngram_jaccard.brute_force(sorted(before.items()))
    assert set(texts(stages["near"])) == {i for i, _, c in rows if i == c}


def test_benchmark(spark, small, stages):
    before = texts(stages["near"])
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    clean = {r[0] for r in decontaminate.brute_force(sorted(before.items()), items) if not r[5]}
    assert set(texts(stages["benchmark"])) == clean


def test_packing(spark, small, stages):
    rows = stages["packing"].collect()
    assert {r.doc_id for r in rows} == set(texts(stages["benchmark"]))
    fill: dict[int, int] = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.03 * -(-sum(fill.values()) // 2048) + 2


def test_run_is_the_stages_in_a_row(spark, small, stages):
    assert corpus_pipeline.run(spark, small).count() == stages["packing"].count()
    assert corpus_pipeline.ORACLE_SQL is None
