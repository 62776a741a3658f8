"""State that several writers change: commits, claims, index inserts, scratch tables of threads."""

from __future__ import annotations

import json
import shutil
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from contextloom.commits import CommitLog, Conflict
from contextloom.operators import registry as G
from contextloom.operators import vectors as V
from contextloom.storage import cut, scratch

NOW = "2024-01-01 00:00:00"


def tasks(spark, n):
    return spark.range(n).select(F.col("id").alias("task_id"), (F.col("id") % 3).cast("int").alias("priority"), F.lit(NOW).alias("created_at"))


def test_one_of_two_writers_gets_a_number(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    base = log.latest()
    assert base.number == 0
    first = log.commit(base, (("a" * 32, 1),), {"by": 1})
    with pytest.raises(Conflict):
        log.commit(base, (("b" * 32, 1),), {"by": 2})
    assert log.latest().meta == {"by": 1} and log.latest().folders == first.folders
    (tmp_path / "t/hint").unlink()  # a hint is no more than that
    assert log.latest().number == 1
    (tmp_path / "t/hint").write_text("7")
    assert log.latest().number == 1
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: log.transact(lambda s: (s.folders, {"n": s.meta.get("n", 0) + 1})), range(20)))
    assert log.latest().meta == {"n": 20} and log.latest().number == 21
    assert not list((tmp_path / "t/commits").glob("draft-*"))


def test_a_task_is_handed_out_once(spark, tmp_path):
    """Two threads, each with a session of its own, take at the same time until nothing is left."""
    path = str(tmp_path / "tasks")
    G.TaskStore(spark, path).submit(tasks(spark, 14))
    start = threading.Barrier(2)

    def worker(agent):
        store = G.TaskStore(spark.newSession(), path)
        mine = []
        start.wait()
        while got := [r.task_id for r in store.take(3, agent, NOW).collect()]:
            mine += got
        return mine

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(worker, (1, 2))
    assert sorted(a + b) == list(range(14))
    rows = {r.task_id: r for r in G.TaskStore(spark, path).rows().collect()}
    assert {i for i, r in rows.items() if r.agent_id == 1} == set(a) and {r.status for r in rows.values()} == {"running"}


def test_what_dies_between_steps_changes_nothing(spark, tmp_path, monkeypatch):
    store = G.TaskStore(spark, str(tmp_path / "tasks"))
    store.submit(tasks(spark, 5))
    store.take(2, 1, NOW)
    before = sorted(map(tuple, store.rows().collect()))
    old = store.rows()

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", die)
        for step in (store.compact, lambda: store.take(2, 2, NOW), lambda: store.submit(tasks(spark, 1))):
            with pytest.raises(KeyboardInterrupt):
                step()
            assert sorted(map(tuple, G.TaskStore(spark, store.path).rows().collect())) == before
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "_create", lambda *_: False)  # another one always comes first
        assert not store.compact()
    assert store.compact() and len(store.log.latest().folders) == 1
    assert sorted(map(tuple, store.rows().collect())) == sorted(map(tuple, old.collect())) == before
    assert store.log.vacuum(0) == 6 and sorted(map(tuple, store.rows().collect())) == before  # of two commits, and four that never were
    assert store.take(9, 3, NOW).count() == 3 and store.take(9, 3, NOW).count() == 0


def test_states_and_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "MANY_FOLDERS", 3)
    table = G.StateTable(spark, str(tmp_path / "t"), "k", "v long")
    for i in range(6):
        table.put(spark.createDataFrame([(1, i), (i + 2, i)], "k long, v long"))
    table.remove(spark.createDataFrame([(4,)], "k long"))
    table.change(lambda have: have.where("k = 1").withColumn("v", F.col("v") + 10))
    assert {r.k: r.v for r in table.rows().collect()} == {1: 15, 2: 0, 3: 1, 5: 3, 6: 4, 7: 5}
    assert len(table.log.latest().folders) == 1


META = V.INDEX.split("meta ")[1].split(", chunk_id")[0]


def chunks(spark, lo, n, dim=4):
    ids = spark.range(lo, lo + n)
    return ids.select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("text").alias("text"), F.array(*[F.lit(1.0).cast("float")] * dim).alias("embedding"), F.lit(None).cast(META).alias("meta"), F.lit("s").alias("source"))


def test_index_inserts_are_single_commits(spark, tmp_path, monkeypatch):
    index = V.VectorIndex(spark, str(tmp_path / "i"), "words")
    assert index.insert(chunks(spark, 0, 4)) == 4
    opened = index.load()
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "_create", lambda *_: (_ for _ in ()).throw(OSError("no")))
        with pytest.raises(OSError):
            index.insert(chunks(spark, 4, 4))
    again = V.VectorIndex.opened(spark, index.path)
    assert again.load().count() == 4 and again.manifest() == V.Manifest(4, "words", 4)
    with ThreadPoolExecutor(2) as pool:  # two writers at once: ids stay dense, none is given twice
        list(pool.map(lambda lo: V.VectorIndex(spark, index.path, "words").insert(chunks(spark, lo, 5)), (10, 20)))
    assert sorted(r.id for r in index.load().collect()) == list(range(14)) and index.manifest().count == 14
    assert index.insert(chunks(spark, 20, 6).unionByName(chunks(spark, 25, 1)), dedup=True) == 1
    assert opened.count() == 4
    shutil.rmtree(next(Path(index.path, "data", f) for f, _ in index.log.latest().folders))
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):  # noqa: B017  a lost file is an error, whichever the reader gives
        V.VectorIndex.opened(spark, index.path)
    assert json.loads((tmp_path / "i/commits/00000000000000000001.json").read_text())["meta"]["count"] == 4


def test_scratch_leaves_what_other_threads_cut(spark):
    opened, counted = threading.Event(), threading.Event()

    def other():
        with scratch(spark):
            opened.set()
            counted.wait(60)

    t = threading.Thread(target=other)
    t.start()
    opened.wait(60)
    frame = cut(spark.range(5))
    counted.set()
    t.join()
    assert frame.count() == 5


def test_tables_cut_under_a_timeout_belong_to_the_scratch_around(spark):
    with scratch(spark):
        frame = G.within(spark, 60, lambda: cut(spark.range(3)))
        assert frame.count() == 3
    with pytest.raises(Exception, match="(?i)file|path"):
        frame.count()
