"""Search by cells against the flat scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from contextloom.operators import pruned as P
from contextloom.operators import vectors as V


def frames(spark, m, q):
    rows = lambda x, name: spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], f"{name} long, embedding array<double>")
    return rows(m, "id").repartition(4), rows(q, "query_id")


def key(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("kind", ["random", "clustered", "tied"])
def test_the_same_hits_as_of_all_vectors(spark, kind):
    r = np.random.default_rng(8)
    if kind == "random":
        m = r.normal(size=(900, 6))
    else:
        m = np.repeat(r.normal(size=(30, 12)), 40, 0)
        m = m + r.normal(size=m.shape) * 0.05 if kind == "clustered" else np.round(m, 1)
    m[5] = 0
    q = np.r_[m[::60], r.normal(size=(4, m.shape[1])), np.zeros((1, m.shape[1]))]
    vectors, queries = frames(spark, m, q)
    cells = P.celled(vectors)
    exact = {"digits": 9} if kind == "tied" else {}  # products of equal vectors may differ in the last bit, by how they are blocked
    for options in (exact, {"digits": 3}, exact | {"least": 0.5, "load_bytes": 600}):
        skipped: list[float] = []
        assert key(P.pruned_top_k(cells, queries, 7, skipped=skipped, **options)) == key(V.top_k(vectors, queries, 7, **options))
        assert len(skipped) >= 1 and (kind == "random" or max(skipped) > 0.5), skipped


def test_odd_input(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [0.0, None]), (4, [0.0, 1.0]), (7, None), (None, [1.0, 0.0]), (9, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.2]), (10, [0.0, 1.0]), (11, [nan, 0.0]), (12, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    got = P.pruned_top_k(P.celled(v), q, 3).collect()
    assert sorted((x.query_id, x["rank"], x.id) for x in got) == sorted([(10, 1, 1), (10, 2, 4), (10, 3, 9), (10, 1, 4), (10, 2, 1), (10, 3, 9)])
    assert P.pruned_top_k(P.celled(v.limit(0)), q, 3).count() == 0 and P.pruned_top_k(P.celled(v), q.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        P.celled(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>"))


def test_scores_of_a_tile_are_held_at_a_time():
    """However large batches are, vectors are multiplied ``TILE`` at a time at most; those that can't be scored are left out."""
    n = 2 * V.TILE + 10
    vectors = [[float(i), 1.0] if i % 5 else [float("nan"), 1.0] if i % 2 else [1.0] for i in range(n)]
    found = list(V.tiles([pa.record_batch({"id": list(range(n)), "v": vectors})], 2))
    assert len(found) == 3 and all(len(ids) == len(m) <= V.TILE for ids, m in found)
    assert [int(i) for ids, _ in found for i in ids] == [int(m) for _, rows in found for m in rows[:, 0]] == [i for i in range(n) if i % 5]
    assert not list(V.tiles([pa.record_batch({"id": [1], "v": [[1.0]]})], 2))
