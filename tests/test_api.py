"""The whole path from files to answers, and what users plug in."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from contextloom import api
from contextloom.operators import registry as G
from contextloom.operators.vectors import VectorIndex
from contextloom.sources.files import ScanOptions


def letters():
    """An embedder that counts three letters; local classes travel to workers by value."""

    class Letters:
        dim = 3

        def load(self):
            return lambda texts: [[t.count(c) for c in "abc"] for t in texts]

    return Letters()


@pytest.mark.parametrize("embedder", [None, letters()])
def test_from_files_to_answers(spark, tmp_path, embedder):
    for name, text in {"one.md": "# Intro\nThe aa aa a lake is deep.\n# Other\nThe bb bbb hill is high.", "two.py": "def ccc():\n    return 'c c c'\n", "skip.log": "x"}.items():
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    index = VectorIndex(spark, str(tmp_path / "index"))
    done = api.ingest(spark, ScanOptions(str(tmp_path / "src")), index, embedder)
    assert done == api.Ingested(2, 3, 3)
    assert api.ingest(spark, ScanOptions(str(tmp_path / "src")), index, embedder, dedup=True).indexed == 0
    q = spark.createDataFrame([(1, "aa aa a lake"), (2, "bb bbb hill")], "query_id long, question string")
    rows = {r.query_id: r for r in api.answer(index, q, embedder).collect()}
    assert "lake" in rows[1].answer and rows[1].answer.endswith("[SOURCE 1]") and "hill" in rows[2].answer
    assert "one.md | score:" in rows[1].prompt
    api.views(spark, idx=index.load())
    assert spark.sql("select count(*) n from idx where meta.language = 'python'").first().n == 1
    with pytest.raises(ValueError):
        api.search(index, q, 0)


def test_generators_fall_back(spark):
    def broken(prompt):
        raise RuntimeError("down")

    df = spark.createDataFrame([(1, "hello")], "id long, prompt string")
    order = G.priorities("Broken, echo,nope", ["broken", "echo"])
    assert order == ["broken", "echo"]
    r = G.generated(df, {"broken": broken, "echo": str.upper}, order).first()
    assert (r.text, r.backend, r.error) == ("HELLO", "echo", None)
    assert G.generated(df, {"broken": broken}, ["broken"]).first().error == "broken: down"
    waits = []
    with pytest.raises(RuntimeError):
        G.with_retries(broken, sleep=waits.append)("x")
    assert waits == [4.0, 8.0]


def test_search_source(spark):
    class Fixed(G.SearchSource):
        @classmethod
        def name(cls):
            return "fixed"

        def search(self, query, n):
            return [{"title": f"{query}{i}", "url": "http://x"} for i in range(9)]

    spark.dataSource.register(Fixed)
    rows = spark.read.format("fixed").option("queries", "a\nb").option("n", "2").load().orderBy("query", "position").collect()
    assert [(r.query, r.position, r.title, r.snippet, r.source) for r in rows] == [("a", 0, "a0", "", "fixed"), ("a", 1, "a1", "", "fixed"), ("b", 0, "b0", "", "fixed"), ("b", 1, "b1", "", "fixed")]


def test_handlers_and_state(spark, tmp_path):
    handlers = G.Handlers(upper=lambda df: df.select("task_id", F.upper("payload").alias("result")))
    tasks = spark.createDataFrame([(1, "upper", "a"), (2, "odd", "b"), (3, None, "c")], "task_id long, task_type string, payload string")
    out = {r.task_id: (r.result, r.error) for r in handlers.run(tasks).collect()}
    assert out == {1: ("A", None), 2: (None, "unknown task type: odd"), 3: (None, "unknown task type: null")}
    path = str(tmp_path / "state")
    G.save_state(tasks, "task_id", path)
    G.save_state(tasks.where("task_id = 1").withColumn("payload", F.lit("z")), "task_id", path)
    rows = G.load_state(spark.read.parquet(path), "task_id", "task_type string, payload string").collect()
    assert {r.task_id: r.payload for r in rows} == {1: "z", 2: "b", 3: "c"}


def test_chunkers_are_registered_by_suffix(spark):
    from contextloom.operators import chunking as C

    files = spark.createDataFrame([("a.ini", "[x]\na=1\n[y]\nb=2"), ("b.TS", "function f(x) { }"), ("c.py", "x = 1")], "path string, content string")
    kinds = lambda: {r.path: r.language for r in C.chunked(files).select("path", "meta.language").distinct().collect()}
    assert kinds() == {"a.ini": "javascript", "b.TS": "javascript", "c.py": "python"}

    def sections(content):
        lines = content.split("\n")
        return [("section", i + 1, i + 1, x, {"name": x.strip("[]")}) for i, x in enumerate(lines) if x.startswith("[")]

    C.register("ini", sections, ".INI", ".cfg")
    C.register("mine", sections, ".py")
    try:
        assert kinds() == {"a.ini": "ini", "b.TS": "javascript"} and C.supported_suffixes()["ini"] == [".cfg", ".ini"]
        assert [r.name for r in C.chunked(files).where("path = 'a.ini'").orderBy("idx").select("meta.name").collect()] == ["x", "y"]
        with pytest.raises(ValueError):
            C.register("bad", sections, "ini")
    finally:
        C.unregister("ini")
        C.unregister("mine")
    assert kinds() == {"a.ini": "javascript", "b.TS": "javascript", "c.py": "python"}


def test_a_timeout_cancels_the_jobs(spark):
    import time

    slow = spark.range(0, 4, 1, 4).mapInArrow(lambda batches: (time.sleep(30) or b for b in batches), "id long")
    began = time.perf_counter()
    with pytest.raises(TimeoutError):
        G.within(spark, 1.5, slow.count)
    assert time.perf_counter() - began < 15
    assert G.within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        G.within(spark, 60, lambda: 1 / 0)


def test_task_store(spark, tmp_path):
    store = G.TaskStore(spark, str(tmp_path / "tasks"), capacity=4)
    assert store.rows().count() == 0
    tasks = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (2, 10, "2024-01-01 00:00:02"), (3, 10, "2024-01-01 00:00:01")], "task_id long, priority int, created_at string")
    assert store.submit(tasks) == 3
    with pytest.raises(OverflowError):
        store.submit(tasks.limit(2).selectExpr("task_id + 10 as task_id", "priority", "created_at"))
    assert [r.task_id for r in store.take(2, 7, "2024-01-01 00:01:00").orderBy("created_at").collect()] == [3, 2]
    again = G.TaskStore(spark, store.path)
    again.finish(spark.createDataFrame([(3, "ok", None), (2, None, "bad")], "task_id long, result string, error string"), "2024-01-01 00:02:00")
    assert {r.task_id: (r.status, r.agent_id, r.result, r.error) for r in store.rows().collect()} == {1: ("queued", None, None, None), 2: ("failed", 7, None, "bad"), 3: ("completed", 7, "ok", None)}
    assert store.cancel(tasks, "2024-01-01 00:03:00") == 1 and store.rows().where("status = 'cancelled'").first().task_id == 1
    store.compact()
    assert store.rows().count() == 3 and store.clean("2024-01-02 00:02:30") == 2 and [r.task_id for r in store.rows().collect()] == [1]


def test_agent_store(spark, tmp_path):
    store = G.AgentStore(spark, str(tmp_path / "agents"))
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    store.put(spark.createDataFrame([(1, "a", ["code"], "online"), (2, "b", [], "busy"), (3, "c", [], "online")], "agent_id long, name string, capabilities array<string>, status string").withColumns({"last_heartbeat": ts, "current_tasks": F.lit(0), "max_concurrent_tasks": F.lit(5)}))
    beats = spark.createDataFrame([(1, "online", 2, "2024-01-01 00:00:40"), (1, "busy", 1, "2024-01-01 00:00:20"), (9, "online", 0, "2024-01-01 00:00:40")], "agent_id long, status string, current_tasks int, at string")
    store.heartbeat(beats)
    assert store.expire("2024-01-01 00:00:50") == 1
    assert {r.agent_id: (r.status, r.current_tasks, r.capabilities) for r in store.rows().collect()} == {1: ("online", 2, ["code"]), 2: ("busy", 0, []), 3: ("unhealthy", 0, [])}
    store.remove(spark.createDataFrame([(2,)], "agent_id long"))
    assert store.rows().count() == 2
