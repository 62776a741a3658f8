"""As-of joins, maps that are merged, and bounded maps, against folds."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextloom.operators import asof as A
from contextloom.operators import maps as M
from contextloom.operators.registry import AgentStore


@pytest.mark.parametrize("parts, hours", [("1", None), ("7", None), ("40", 1.0)])
def test_as_of_equals_a_fold(spark, parts, hours):
    """One key has most of the rows, so its partitions go on from one to the next; others come and go."""
    r = np.random.default_rng(4)
    pick = lambda n: [None if k == 5 else 0 if k > 5 else int(k) for k in r.integers(0, 20, n)]
    left = [(i, k, None if i == 3 else int(t)) for i, (k, t) in enumerate(zip(pick(700), r.integers(0, 20_000, 700), strict=True))]
    right = [(int(t), k, 1000 + i) for i, (k, t) in enumerate(zip(pick(60), r.integers(0, 20_000, 60), strict=True))] + [(500, 0, 5000), (500, 0, 5001), (9_000, 2, 5002)]
    at = lambda c: F.timestamp_seconds(c)
    a = spark.createDataFrame(left, "id long, k long, t long").withColumn("t", at("t")).repartition(4)
    b = spark.createDataFrame(right, "w long, k long, write long").withColumn("w", at("w")).repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.id: x.write for x in A.asof_join(a, b, "k", "t", "w", ["write"], hours).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for i, k, t in left:
        before = [(w, x) for w, q, x in right if k is not None and t is not None and q == k and w <= t]
        best = max(before, default=None)
        want[i] = best[1] if best and (hours is None or t - best[0] < hours * 3600) else None
    assert got == want
    assert A.asof_join(a.limit(0), b, "k", "t", "w", ["write"]).count() == 0
    assert {x.write for x in A.asof_join(a, b.limit(0), "k", "t", "w", ["write"]).collect()} == {None}
    with pytest.raises(ValueError, match="left side"):
        A.asof_join(a, b, "k", "t", "w", ["k"])


def test_maps_are_merged_by_the_last_value(spark):
    rows = [(1, 10, {"a": "x", "b": "y"}), (1, 12, {"a": None}), (1, 11, {"a": "z", "c": "w"}), (2, 1, {}), (3, 1, None), (None, 5, {"k": "v"}), (1, 12, {"d": "p"}), (1, 12, {"d": "q"})]
    df = spark.createDataFrame(rows, "id long, at long, m map<string,string>").repartition(3)
    assert {r.id: r.m for r in M.merged_maps(df, "id", "at", "m").collect()} == {1: {"a": None, "b": "y", "c": "w", "d": "q"}, 2: {}, 3: {}, None: {"k": "v"}}
    hot = spark.range(30_000).select(F.lit(7).alias("id"), F.col("id").alias("at"), F.create_map(F.concat(F.lit("n"), F.col("id") % 5), F.col("id").cast("string")).alias("m"))
    assert M.merged_maps(hot, "id", "at", "m").first().m == {f"n{i}": str(29_995 + i) for i in range(5)}


def test_heartbeats_merge_metadata(spark, tmp_path):
    store = AgentStore(spark, str(tmp_path / "agents"))
    store.put(spark.createDataFrame([(1, "a", ["code"], "online", None, 0, 5, {"host": "h"}), (2, "b", [], "online", None, 0, 5, None)], "agent_id long, " + store.schema))
    store.heartbeat(spark.createDataFrame([(1, "busy", 2, "2024-01-01 00:00:05", {"cpu": "1"}), (1, "online", 1, "2024-01-01 00:00:01", {"cpu": "0", "os": "x"}), (9, "online", 0, "2024-01-01 00:00:01", {})], "agent_id long, status string, current_tasks int, at string, metadata map<string,string>"))
    store.heartbeat(spark.createDataFrame([(2, "online", 3, "2024-01-01 00:00:07")], "agent_id long, status string, current_tasks int, at string"))
    got = {r.agent_id: r for r in store.rows().collect()}
    assert set(got) == {1, 2} and got[1].metadata == {"host": "h", "cpu": "1", "os": "x"} and got[1].status == "busy" and got[2].metadata is None and got[2].current_tasks == 3


def test_a_bounded_map_is_an_ordered_dictionary(spark):
    r = np.random.default_rng(3)
    rows = [(int(r.integers(3)), i, int(r.integers(12)), bool(r.random() < 0.7)) for i in range(600)]
    df = spark.createDataFrame([(None if o == 2 else o, i, None if e == 11 else e, s) for o, i, e, s in rows], "o long, i long, e long, s boolean").repartition(5)
    got = {x.i: (x.evicted, x.held) for x in M.bounded(df, "o", "i", "e", F.col("s"), 4).collect()}
    now: dict[int, OrderedDict] = {}
    for o, i, e, s in rows:
        mine, gone = now.setdefault(o, OrderedDict()), None
        if not s:
            mine.pop(e, None)
        else:
            if len(mine) >= 4 and e not in mine:
                gone = mine.popitem(last=False)[0]
            mine.setdefault(e)
        assert got[i] == (None if gone == 11 else gone, len(mine))
    assert M.bounded(df.limit(0), "o", "i", "e", F.col("s"), 4).count() == 0
