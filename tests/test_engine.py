"""Vectors, index, retrieval, tasks, limits, files and streams."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextloom.operators import limits as L
from contextloom.operators import rag as R
from contextloom.operators import tasks as T
from contextloom.operators import vectors as V
from contextloom.sources import files as S
from contextloom.sources import web as W
from contextloom.sources.robots import robots_allowed
from contextloom.streaming import events as E
from contextloom.streaming import timers


def vectors(spark, m, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")


def test_top_k_equals_brute_force(spark):
    m = np.random.default_rng(1).normal(size=(60, 8)).astype(np.float32)
    m[7], m[9] = m[3], 0
    got = {}
    q = vectors(spark, m[:5]).withColumnRenamed("id", "query_id")
    for r in V.top_k(vectors(spark, m).repartition(5), q, 7, block=2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    u = V.unit_rows(m.astype(float))
    for i in range(5):
        s = u @ u[i]
        assert list(dict(sorted(got[i].items())).values()) == sorted(range(60), key=lambda j: (-s[j], j))[:7]
    assert V.top_k(vectors(spark, m[:3]), q, 7).count() == 15
    assert V.top_k(vectors(spark, m[:0]), q, 7).count() == 0
    assert V.top_k(vectors(spark, m), q.limit(0), 7).count() == 0
    one = V.top_k(vectors(spark, m).repartition(3), q, 7, digits=6)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    for other in ({"strategy": "native"}, {"load_bytes": 700}, {"strategy": "native", "load_bytes": 1}):  # several scans
        assert key(V.top_k(vectors(spark, m).repartition(3), q, 7, digits=6, **other)) == key(one)


@pytest.mark.parametrize("strategy", ["blocked", "native"])
def test_odd_vectors_are_no_hits(spark, strategy):
    """Null, NaN and infinite elements, other dimensions and empty vectors, among vectors and queries."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [0.0, None]), (4, [0.0, 1.0]), (5, [1.0, 1.0, 1.0]), (6, []), (7, None), (8, [inf, 0.0]), (None, [1.0, 0.0]), (9, [0.0, 0.0])]
    asked = [(10, [1.0, 0.2]), (11, [nan, 0.0]), (12, [1.0, 0.0, 0.0]), (13, None), (14, [None, 1.0]), (15, [0.2, 1.0]), (16, []), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    got = {}
    for r in V.top_k(v, q, 3, strategy=strategy).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    assert got == {10: {1: 1, 2: 4, 3: 9}, 15: {1: 4, 2: 1, 3: 9}, 12: {1: 5}} | ({16: {1: 6}} if 16 in got else {})


def test_softmax_counts_all_vectors(spark):
    m = np.random.default_rng(2).normal(size=(3000, 6)).astype(np.float32)
    q = vectors(spark, m[:4]).withColumnRenamed("id", "query_id")
    u = V.unit_rows(m.astype(float))
    for options in ({}, {"load_bytes": 1, "block": 1}):
        for r in V.softmax_top(vectors(spark, m).repartition(7), q, 5, scale=3.0, **options).collect():
            e = np.exp(3.0 * (u @ u[r.query_id]))
            assert r.p == pytest.approx(e[r.id] / e.sum()) and (r["rank"] > 1 or r.id == r.query_id)
    assert V.softmax_top(vectors(spark, m), q.limit(0), 5).count() == 0


def test_index(spark, tmp_path):
    index = V.VectorIndex(spark, str(tmp_path / "index"))
    meta = F.lit(None).cast(V.INDEX.split("meta ")[1].split(", chunk_id")[0]).alias("meta")
    rows = spark.createDataFrame([("c1", "one two"), ("c2", "  "), ("c3", "three")], "chunk_id string, text string")
    embedded = V.hash_embedded(rows, "chunk_id", "text", 16).join(rows, "chunk_id").select("*", meta, F.lit("t").alias("source"))
    assert index.load().count() == 0
    assert index.insert(embedded) == 2
    assert index.insert(embedded, dedup=True) == 0
    assert index.insert(embedded) == 2
    assert [r.id for r in index.load().orderBy("id").collect()] == [0, 1, 2, 3]
    q = V.hash_embedded(spark.createDataFrame([(5, "three")], "query_id long, text string"), "query_id", "text", 16)
    hits = index.search(q, 2).orderBy("rank").collect()
    assert [h.text for h in hits] == ["three", "three"] and hits[0].score == pytest.approx(1)
    assert index.stats().first().total == 4
    index.clear()
    assert index.load().count() == 0


def test_index_manifest(spark, tmp_path):
    meta = F.lit(None).cast(V.INDEX.split("meta ")[1].split(", chunk_id")[0]).alias("meta")
    rows = lambda n, dim: spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("text").alias("text"), F.array(*[F.lit(1.0).cast("float")] * dim).alias("embedding"), meta, F.lit("s").alias("source"))
    index = V.VectorIndex(spark, str(tmp_path / "index"), "words")
    assert index.insert(rows(3, 4)) == 3 and index.manifest() == V.Manifest(4, "words", 3)
    with pytest.raises(ValueError, match="dimensions"):
        index.insert(rows(2, 5))
    with pytest.raises(ValueError, match="dimensions"):
        index.insert(rows(2, 4).unionByName(rows(1, 3)))
    with pytest.raises(ValueError, match="other"):
        V.VectorIndex(spark, index.path, "other").insert(rows(1, 4))
    assert index.load().count() == 3
    index.export(str(tmp_path / "copy"))
    copy = V.VectorIndex.opened(spark, str(tmp_path / "copy"))
    assert copy.model == "words" and copy.insert(rows(1, 4)) == 1 and copy.manifest().count == 4 and index.load().count() == 3
    copy.log.transact(lambda state: (state.folders[:1], state.meta))  # a commit that lost a folder
    with pytest.raises(ValueError, match="manifest"):
        V.VectorIndex.opened(spark, copy.path)
    with pytest.raises(FileNotFoundError):
        V.VectorIndex.opened(spark, str(tmp_path / "none"))


def test_dense_ids_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    out = V.with_index_ids(rows, 10, "k").collect()
    assert sorted((r.k, r.id) for r in out) == [(k, k + 10) for k in range(1000)]


def test_dense_ids_of_wide_rows_under_small_partitions(spark, tmp_path):
    """Counts and ids agree although adaptive execution merges partitions of wide and of narrow rows differently."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "40"}
    old = {k: spark.conf.get(k) for k in conf}
    n = 60_000
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(n).select(F.concat(F.lpad(F.col("id").cast("string"), 8, "0")).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text")).repartition(7)
        hot = rows.select(F.when(F.col("k") % 3 == 0, "00000000").otherwise(F.col("k")).alias("k"), "text")
        for df in (rows, hot):
            out = V.with_index_ids(df, 5, "k")
            for parallel in ("4", "48"):
                spark.conf.set("spark.sql.leafNodeDefaultParallelism", parallel)
                got = out.select("k", "id").orderBy("id").collect()
                assert [r.id for r in got] == list(range(5, n + 5)) and [r.k for r in got] == sorted(r.k for r in got)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_scratch_tables_go(spark):
    from contextloom.storage import base_dir, cut, release, scratch

    made = lambda: set(Path(base_dir(spark).removeprefix("file://")).glob("*"))
    before = made()
    with scratch(spark) as outer:
        with scratch(spark) as inner:
            a, b = cut(spark.range(3)), cut(spark.range(4))
            inner.keep(b)
        assert len(made() - before) == 1 and b.count() == 4
        c = cut(b)
        outer.keep(c)
    assert len(made() - before) == 1 and c.count() == 4
    release(c, a)
    assert made() == before


def test_contexts_and_prompt(spark):
    hits = spark.createDataFrame([(1, i, s, i) for i, s in enumerate([0.5, 0.9, None, 0.7, 0.6, 0.8])], "query_id long, id long, score double, rank int")
    assert [r.id for r in R.kept_contexts(hits, "query_id").orderBy("place").collect()] == [1, 5, 3, 4, 0]
    line = R.context_line(F.lit(1), F.lit(""), F.lit("u"), F.lit(0.12345), F.lit("t"))
    assert spark.range(1).select(line.alias("x")).first().x == "[SOURCE 1 | u | score: 0.123]\nt"
    p = spark.range(1).select(R.prompt(F.lit("q?"), F.lit(None).cast("string"), F.lit("")).alias("x")).first().x
    assert R.NO_CONTEXTS in p and R.NO_WEB in p and "q?" in p and "${" not in p


def test_chat_needs_a_user_last(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "assistant", "z"), (3, 0, "user", None)], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in R.chat_prompts(rows).collect()}
    assert out[1].prompt == "Previous conversation:\nUser: a\nAssistant: b\n\nCurrent question: c"
    assert out[1].direct_prompt == "Human: a\nAssistant: b\nHuman: c\nAssistant: "
    assert (out[1].valid, out[2].valid, out[3].prompt) == (True, False, "")


def test_queue(spark):
    rows = [(1, 1, "queued", 5, []), (2, 20, "queued", 6, ["code"]), (3, 10, "running", 1, []), (4, 20, "queued", 2, ["files"])]
    t = spark.createDataFrame(rows, "task_id long, priority int, status string, created_at long, required_capabilities array<string>")
    assert [(r.task_id) for r in T.dequeue_rank(t).orderBy("queue_rank").collect()] == [4, 2, 1]
    agents = spark.createDataFrame([(9, ["code"], "online", 0, 5, 1), (8, ["files", "code"], "online", 5, 5, 2), (7, [], "online", 1, 5, 3), (6, ["files"], "busy", 0, 5, 4)], "agent_id long, capabilities array<string>, status string, current_tasks int, max_concurrent_tasks int, registered_at long")
    assert {r.task_id: r.agent_id for r in T.assignment_pass(t, agents).collect()} == {2: 9, 4: 7}
    assert {r.task_id: r.n_agents for r in T.agents_for_tasks(t, agents).collect()} == {1: 4, 2: 3, 3: 4, 4: 3}
    assert {r.capability: r.agent_id for r in T.least_loaded(agents).collect()} == {"code": 9}
    assert [r.accepted for r in T.admitted(t, 2).orderBy("arrival").collect()] == [True, True, False, False]
    empty = t.limit(0)
    assert T.dequeue_rank(empty).count() == 0 and T.assignment_pass(empty, agents).count() == 0


def test_limiter_equals_a_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(3)), float(t), i) for i, t in enumerate(np.sort(rng.uniform(0, 300, 400)))]
    df = spark.createDataFrame(rows, "client long, at double, request_id long").withColumn("at", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    got = {r.request_id: r.allowed for r in L.rate_decisions(df, limit=10).collect()}
    logs: dict[int, list[int]] = {}
    for c, t, i in rows:
        m = int(t * 1e6)
        log = logs[c] = [x for x in logs.get(c, []) if x > m - 60_000_000]
        assert got[i] == (len(log) < 10)
        if len(log) < 10:
            log.append(m)


def test_spacing_of_a_hot_domain_over_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(0 if i % 3 else int(rng.integers(1, 5)), int(t), i) for i, t in enumerate(rng.integers(0, 400_000_000, 900))]
    df = spark.createDataFrame([(None if d == 4 else d, t, i) for d, t, i in rows], "d long, t long, i long").withColumn("t", F.timestamp_micros("t")).repartition(5)
    got = {r.i: r.sent_micros for r in L.spaced(df, "d", "t", "i").collect()}
    last: dict[int, int] = {}
    for d, t, i in sorted(rows):
        last[d] = max(t, last.get(d, -10**9) + 1_000_000)
        assert got[i] == last[d]


def test_spacing_equals_a_fold(spark):
    rows = [(0, 0.0, 0), (0, 0.2, 1), (0, 0.3, 2), (0, 9.0, 3), (1, 5.0, 4)]
    df = spark.createDataFrame(rows, "d long, t double, i long").withColumn("t", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    assert {r.i: r.wait_micros for r in L.spaced(df, "d", "t", "i").collect()} == {0: 0, 1: 800_000, 2: 1_700_000, 3: 0, 4: 0}


def test_files(spark, tmp_path):
    for name, raw in {"a.py": b"x\r\ny", "sub/b.md": "é".encode("latin-1") + b"x!", "node_modules/c.js": b"1", "big.txt": b"z" * 200, "d.bin": b"0"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.path: r for r in S.read_files(spark, S.ScanOptions(str(tmp_path), max_file_size=100)).collect()}
    assert set(got) == {"a.py", "sub/b.md"}
    assert got["a.py"].content == "x\ny" and got["sub/b.md"].encoding == "latin-1"
    assert {r.path: r.extension for r in S.list_files(spark, S.ScanOptions(str(tmp_path))).collect()} == {"a.py": "py", "sub/b.md": "md", "big.txt": "txt"}
    assert [r.path for r in S.read_files(spark, S.ScanOptions(str(tmp_path), max_files=1)).collect()] == ["a.py"]
    assert {r.path for r in S.list_files(spark, S.ScanOptions(str(tmp_path), recursive=False)).collect()} == {"a.py", "big.txt"}
    (tmp_path / "a.md").write_bytes(b"one")
    assert [r.path for r in S.read_files(spark, S.ScanOptions(str(tmp_path), max_files=2)).orderBy("path").collect()] == ["a.md", "a.py"]
    with pytest.raises(ValueError):
        S.ScanOptions("a/../b")


def test_what_becomes_of_each_file(spark, tmp_path, monkeypatch):
    for name, raw in {"a.py": b"x = 1", "b/c.md": b"# t", "d.bin": b"0", "big.py": b"y" * 500, "odd.py": b"\xff\xfe\xfd", "node_modules/z.py": b"z", "z1.py": b"1", "z2.py": b"2", "gone.py": b"g"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    monkeypatch.setattr(S, "ENCODINGS", ("utf-8",))  # else one of them fits anything
    monkeypatch.setattr(S, "decode", F.pandas_udf(S.decode.func, S.decode.returnType))
    options = S.ScanOptions(str(tmp_path), max_file_size=100, max_files=5)
    found = S.found_files

    def losing(spark, options, forgiving=False):
        rows = found(spark, options, forgiving)
        return rows.where("path <> 'gone.py'") if forgiving else rows  # as if it went after it was listed

    monkeypatch.setattr(S, "found_files", losing)
    got = {r.path: (r.outcome, r.error) for r in S.scan_outcomes(spark, options).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.py": "processed", "b/c.md": "processed", "d.bin": "name", "big.py": "size", "odd.py": "error", "node_modules/z.py": "name", "z1.py": "processed", "z2.py": "limit", "gone.py": "error"}
    assert got["gone.py"][1] == "Error processing gone.py: it can't be read" and "encoding" in got["odd.py"][1] and got["a.py"][1] is None
    totals = S.scan_totals(S.scan_outcomes(spark, options)).first()
    assert (totals.found, totals.processed, totals.skipped, totals.bytes, totals.errors) == (9, 3, 6, 9, 2)


def test_uploads(spark):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:d xmlns:w="{w}"><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:t>World</w:t></w:p></w:d>')
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (4).to_bytes(4, "big")
    rows = [("a", bytearray(docx.getvalue()), S.DOCX), ("b", bytearray(png), "image/png"), ("c", bytearray(b"hi"), "text/plain"), ("d", bytearray(b"x"), "video/mp4"), ("e", bytearray(b"bad"), S.DOCX)]
    out = {r.name: r for r in S.uploads(spark.createDataFrame(rows, "name string, content binary, mime string")).collect()}
    assert {k: r.extracted_text for k, r in out.items()} == {"a": "Hello\nWorld", "b": "png 3x4", "c": "hi", "e": ""}
    assert out["c"].data == "aGk=" and out["c"].id.startswith("file_")


def test_images_by_tiers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4, "big") + (4).to_bytes(4, "big")

    def broken(raw):
        raise RuntimeError("no model")

    def labels(raw):
        return {"a chart": 0.6, "a table": 0.3, "code": 0.06, "text": 0.04} if len(raw) == len(png) else {}

    df = spark.createDataFrame([("a", bytearray(png)), ("b", bytearray(png + b"x")), ("c", bytearray(b"no image")), ("d", None)], "name string, content binary")
    got = {r.name: r.d for r in df.select("name", S.image_description([broken, labels])(F.col("content")).alias("d")).collect()}
    assert got == {"a": "png 3x4: a chart (60.0%), a table (30.0%), code (6.0%)", "b": "png 3x4", "c": None, "d": None}
    up = spark.createDataFrame([("a", bytearray(png), "image/png")], "name string, content binary, mime string")
    assert S.uploads(up, image_tiers=[labels]).first().extracted_text.endswith("code (6.0%)")


def test_pages():
    title, text = W.parsed_page("<html><head><title> T &amp; U</title><style>p{}</style></head><body><p>a  b</p>\n<script>x</script> c</body>")
    assert (title, text) == ("T & U", "T & Ua b c")  # neighbouring texts are not parted
    assert W.parsed_page(None) == ("", "")


def test_robots(spark):
    pages = spark.createDataFrame([("h", "/a/x"), ("h", "/a/b/x"), ("h", "/z"), ("k", "/a")], "host string, path string")
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True)], "host string, prefix string, allow boolean")
    assert {(r.host, r.path): r.allowed for r in robots_allowed(pages, rules).collect()} == {("h", "/a/x"): False, ("h", "/a/b/x"): True, ("h", "/z"): True, ("k", "/a"): True}


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams_equal_batches(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "all"))
    stream = E.event_stream(spark, str(tmp_path / "all"))
    got = drained(E.tumbling(stream), "tumbling_out")
    batch = E.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: {(r.start, r.event_type): r.n for r in df.collect()}
    g, b = key(got), key(batch)
    assert g and all(b[k] == n for k, n in g.items())  # windows that the watermark has passed
    decided = drained(timers.rate_limited(E.event_stream(spark, str(tmp_path / "all")), 3, 36_000), "limited_out")
    model = L.rate_decisions(events, "user_id", "ts", "event_id", 3, 36_000)
    assert {r.event_id: r.allowed for r in decided.collect()} == {r.request_id: r.allowed for r in model.collect()}


def test_task_states_as_a_stream(spark, small, tmp_path):
    kind = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "cancelled").otherwise("completed")
    rows = spark.read.parquet(f"{small}/lineitem.parquet").select(F.col("l_orderkey").alias("task_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("at"), kind.alias("event"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # keys in parts
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = drained(E.task_states(stream), "states_out", "update")
    key = lambda df: {r.task_id: (r.status, r.illegal) for r in df.collect()}
    assert key(got) == key(T.final_states(rows))


def test_feed(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in"))
    seen = []
    q = E.feed(E.event_stream(spark, str(tmp_path / "in")), lambda df, n: seen.append((n, df.count())), "1 second", str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert sum(n for _, n in seen) == 1000


def test_page_parsed_has_every_page(spark, tmp_path):
    from contextloom.plans import pages

    rows = [(1, "<title>t</title>" + "word " * 300_000), (2, "<p>x"), (3, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.title, r.content_length) for r in pages.page_parsed(spark, str(tmp_path)).collect()}
    assert got == {1: ("t", 1_500_000), 2: ("", 1), 3: ("", 0)}


def test_callbacks_are_called_once(spark):
    heard, calls = [], E.Callbacks()

    def broken(row):
        raise RuntimeError("no")

    for task in (1, 2, 3):
        calls.add(task, lambda r: heard.append((r.task_id, r.status)))
    calls.add(1, broken)
    states = spark.createDataFrame([(1, "completed"), (2, "running"), (4, "failed")], "task_id long, status string")
    calls.deliver(states)
    calls.deliver(states)
    assert heard == [(1, "completed")] and [i for i, _ in calls.errors] == [1] and set(calls.waiting) == {2, 3}
