"""What users plug in: embedders, generators with fallback, search providers and task handlers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from contextvars import copy_context
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from contextloom.commits import CommitLog, Conflict, Snapshot
from contextloom.operators.maps import merged, merged_maps
from contextloom.operators.tasks import TERMINAL
from contextloom.operators.vectors import hash_embedded
from contextloom.storage import cut


class Embedder(Protocol):
    """Turns texts into vectors; ``load`` runs once in each worker."""

    dim: int

    def load(self) -> Callable[[list[str]], Sequence[Sequence[float]]]: ...


def embedded(rows: DataFrame, key: str, text: str, embedder: Embedder | None = None, dim: int = 256) -> DataFrame:
    """(key, embedding) by a given model, or by hashed word counts without one."""
    if embedder is None:
        return hash_embedded(rows, key, text, dim)
    picked = rows.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = embedder.load()
        for batch in batches:
            vectors = encode(batch.column(1).to_pylist()) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=[key, "embedding"])

    return picked.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<float>")


Generate = Callable[[str], str]


def with_retries(generate: Generate, tries: int = 3, first_wait: float = 4.0, most_wait: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> Generate:
    """The generator, tried again after growing waits."""

    def run(prompt: str) -> str:
        for k in range(tries):
            try:
                return generate(prompt)
            except Exception:
                if k + 1 == tries:
                    raise
                sleep(min(most_wait, first_wait * 2**k))
        raise AssertionError("unreachable")

    return run


def generated(prompts: DataFrame, adapters: dict[str, Generate], order: Sequence[str], prompt: str = "prompt") -> DataFrame:
    """``prompts`` with text and backend of the first adapter in ``order`` that answers; error says why none did."""
    chosen = [(name, adapters[name]) for name in order if name in adapters]

    @F.pandas_udf("text string, backend string, error string")
    def answer(batch: pd.Series) -> pd.DataFrame:
        out = []
        for p in batch:
            failed: list[str] = []
            for name, generate in chosen:
                try:
                    out.append((generate(p), name, None))
                    break
                except Exception as e:  # an adapter may fail in any way; the next one is asked
                    failed.append(f"{name}: {e}")
            else:
                out.append((None, None, "; ".join(failed) or "no adapter"))
        return pd.DataFrame(out, columns=["text", "backend", "error"])

    return prompts.withColumn("_a", answer(F.col(prompt))).select(*prompts.columns, "_a.text", "_a.backend", "_a.error")


def priorities(text: str, known: Iterable[str]) -> list[str]:
    """Names of a comma-separated list that are known, in its order."""
    known = set(known)
    return list(dict.fromkeys(x for x in (p.strip().lower() for p in text.split(",")) if x in known))


class SearchSource(DataSource):
    """A search provider as a data source: ``spark.read.format("search").option("queries", "a\\nb").load()``.

    Subclasses give ``name`` and ``search(query, n)`` with dictionaries of title, snippet and url. Each query is a
    partition, so a failed one is retried alone.
    """

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return "query string, position int, title string, snippet string, url string, source string"

    def search(self, query: str, n: int) -> list[dict[str, str]]:
        raise NotImplementedError

    def reader(self, schema: Any) -> DataSourceReader:
        return _SearchReader(self)


class _SearchReader(DataSourceReader):
    def __init__(self, source: SearchSource):
        self.source, self.n = source, int(source.options.get("n", "5"))
        self.queries = [q for q in source.options.get("queries", "").split("\n") if q]

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, r in enumerate(self.source.search(partition.value, self.n)[: self.n]):
            yield partition.value, i, r.get("title", ""), r.get("snippet", ""), r.get("url", ""), self.source.name()


Handler = Callable[[DataFrame], DataFrame]
MANY_FOLDERS = 48  # a state table of more is compacted


class Handlers:
    """Task handlers by type: frames of (task_id, payload) to frames of (task_id, result)."""

    def __init__(self, **handlers: Handler):
        self.handlers: dict[str, Handler] = dict(handlers)

    def register(self, kind: str, handler: Handler) -> None:
        self.handlers[kind] = handler

    def run(self, tasks: DataFrame) -> DataFrame:
        """(task_id, result, error) of tasks (task_id, task_type, payload); an unknown type is an error, not a failure."""
        unknown = tasks.where(~F.col("task_type").isin(*self.handlers) | F.col("task_type").isNull()) if self.handlers else tasks
        out = unknown.select("task_id", F.lit(None).cast("string").alias("result"), F.concat(F.lit("unknown task type: "), F.coalesce("task_type", F.lit("null"))).alias("error"))
        for kind, handler in self.handlers.items():
            done = handler(tasks.where(F.col("task_type") == kind).select("task_id", "payload"))
            out = out.unionByName(done.select("task_id", F.col("result").cast("string"), F.lit(None).cast("string").alias("error")))
        return out


def within(spark: SparkSession, seconds: float, action: Callable[[], Any]) -> Any:
    """The result of an action on frames; if it takes longer, its Spark jobs are cancelled and TimeoutError is raised."""
    tag = f"loom-{uuid.uuid4().hex}"

    def run() -> Any:
        spark.addTag(tag)
        try:
            return action()
        finally:
            spark.removeTag(tag)

    pool = ThreadPoolExecutor(1)
    waiting = pool.submit(copy_context().run, run)  # tables cut inside belong to the scratch around
    try:
        return waiting.result(seconds)
    except FutureTimeout:
        if waiting.done():
            raise
        spark.interruptTag(tag)
        raise TimeoutError(f"timed out after {seconds} s") from None
    finally:
        pool.shutdown(wait=False)  # a cancelled job may take its time to end


def state_json(columns: Sequence[str]) -> Column:
    """A row's state as JSON, to keep tasks or agents in a key-value table."""
    return F.to_json(F.struct(*columns))


def save_state(rows: DataFrame, key: str, path: str) -> None:
    """Append states (key, state, version); the last version of a key counts. A state of null ends the key."""
    columns = [c for c in rows.columns if c != key]
    rows.select(F.col(key), state_json(columns).alias("state"), F.lit(time.time_ns()).alias("version")).write.mode("append").parquet(path)


def load_state(rows: DataFrame, key: str, schema: str) -> DataFrame:
    """The last state of each key, as columns again."""
    last = rows.groupBy(key).agg(F.max_by("state", "version").alias("state")).where("state is not null")
    return last.select(key, F.from_json("state", schema).alias("s")).select(key, "s.*")


class StateTable:
    """Rows by key that outlive the session, on a log of commits: the last state of each key counts.

    ``change`` is the way to change rows that hang on what the table holds: it starts again if another writer commits in
    between, so no two of them act on the same state. A process that dies leaves the last commit as it was.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        self.kinds = dict(f.split(" ", 1) for f in schema.split(", "))
        self.log = CommitLog(spark, path)
        self.raw = f"{key} long, state string"

    def rows(self, snapshot: Snapshot | None = None) -> DataFrame:
        """The table now, or as it was after a commit; what is committed later doesn't change the frame."""
        return load_state(self.log.rows(snapshot or self.log.latest(), self.raw, "version"), self.key, self.schema)

    def states(self, rows: DataFrame) -> DataFrame:
        """Rows as states; columns that they lack are null."""
        full = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in self.kinds.items() if c not in rows.columns})
        return full.select(self.key, state_json(list(self.kinds)).alias("state"))

    def change(self, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Commit the rows that ``build`` makes of the table's; returns them, read from where they were written.

        ``build`` may be called several times. No rows make no commit.
        """
        written = ""

        def attempt(base: Snapshot) -> tuple[tuple[tuple[str, int], ...], dict[str, Any]] | None:
            nonlocal written
            written = self.log.write(self.states(build(self.rows(base))))
            if self.spark.read.schema(self.raw).parquet(self.log.folder(written)).isEmpty():
                return None
            return (*base.folders, (written, base.number + 1)), base.meta

        done = self.log.transact(attempt)
        if len(done.folders) > MANY_FOLDERS:
            self.compact()
        rows = self.spark.read.schema(self.raw).parquet(self.log.folder(written))
        return rows.select(self.key, F.from_json("state", self.schema).alias("s")).select(self.key, "s.*")

    def put(self, rows: DataFrame) -> None:
        """Rows that don't hang on the table's; two writers of one key leave the later one's."""
        self.log.append(self.states(rows))

    def remove(self, keys: DataFrame) -> None:
        self.log.append(keys.select(self.key, F.lit(None).cast("string").alias("state")))

    def compact(self) -> bool:
        """Keep the last state of each key only, in one commit; False if another one came first, which leaves all as it is."""
        base = self.log.latest()
        name = self.log.write(self.states(self.rows(base)))
        try:
            self.log.commit(base, ((name, base.number + 1),), base.meta)
        except Conflict:
            return False
        return True


class TaskStore(StateTable):
    """A task queue on a state table: submit, take, finish, cancel, clean up."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = 10_000):
        super().__init__(spark, path, "task_id", "status string, priority int, created_at timestamp, started_at timestamp, completed_at timestamp, agent_id long, result string, error string")
        self.capacity = capacity

    def submit(self, tasks: DataFrame) -> int:
        """Queue tasks (task_id, priority, created_at); an error if they don't find room. The size of the queue."""
        new = tasks.select("task_id", F.lit("queued").alias("status"), F.col("priority").cast("int").alias("priority"), F.col("created_at").cast("timestamp").alias("created_at"))
        more, size = new.count(), 0

        def build(have: DataFrame) -> DataFrame:
            nonlocal size
            size = have.where("status = 'queued'").count() + more
            if size > self.capacity:
                raise OverflowError(f"{size} tasks for a queue of {self.capacity}")
            return new

        self.change(build)
        return size

    def take(self, n: int, agent_id: int, now: str) -> DataFrame:
        """The next ``n`` queued tasks, which the agent runs from now on: higher priority first, then older, then smaller id.

        A task is handed out once, however many agents, threads and sessions take at the same time.
        """

        def build(have: DataFrame) -> DataFrame:
            head = have.where("status = 'queued'").orderBy(F.desc("priority"), "created_at", "task_id").limit(n)
            return head.withColumns({"status": F.lit("running"), "started_at": F.lit(now).cast("timestamp"), "agent_id": F.lit(agent_id).cast("long")})

        return self.change(build)

    def finish(self, results: DataFrame, now: str) -> None:
        """Results (task_id, result, error): failed if there is an error, else completed. As in ``tasks``, whatever was before."""
        ended = results.select("task_id", F.col("result").cast("string"), F.col("error").cast("string"))
        state = {"status": F.when(F.col("error").isNull(), "completed").otherwise("failed"), "completed_at": F.lit(now).cast("timestamp")}
        self.change(lambda have: have.drop("result", "error").join(ended, "task_id").withColumns(state))

    def cancel(self, keys: DataFrame, now: str) -> int:
        """Cancel tasks that haven't ended; how many."""
        state = {"status": F.lit("cancelled"), "completed_at": F.lit(now).cast("timestamp")}
        return self.change(lambda have: have.join(keys.select("task_id"), "task_id", "left_semi").where(~F.col("status").isin(*TERMINAL)).withColumns(state)).count()

    def clean(self, now: str, hours: int = 24) -> int:
        """Forget tasks that ended longer than ``hours`` ago; how many."""
        limit = F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))
        base = self.log.latest()
        old = cut(self.rows(base).where(F.col("status").isin(*TERMINAL) & (F.col("completed_at") < limit)).select("task_id"))  # ended tasks don't change again
        self.remove(old)
        return old.count()


class AgentStore(StateTable):
    """A registry of agents on a state table: register, heartbeat, expire."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "agent_id", "name string, capabilities array<string>, status string, last_heartbeat timestamp, current_tasks int, max_concurrent_tasks int, metadata map<string,string>")

    def heartbeat(self, beats: DataFrame) -> None:
        """Last state wins: beats (agent_id, status, current_tasks, at) of known agents; a map ``metadata`` is merged into what is known."""
        last = beats.groupBy("agent_id").agg(F.max(F.struct("at", "status", "current_tasks")).alias("b"))
        if "metadata" in beats.columns:
            last = last.join(merged_maps(beats, "agent_id", "at", "metadata"), "agent_id")
        last = last.withColumnRenamed("metadata", "told") if "metadata" in last.columns else last.withColumn("told", F.lit(None).cast("map<string,string>"))
        now = ("b.status", F.col("b.current_tasks").cast("int").alias("current_tasks"), F.col("b.at").cast("timestamp").alias("last_heartbeat"))

        def build(have: DataFrame) -> DataFrame:
            rows = have.drop("status", "current_tasks", "last_heartbeat").join(last, "agent_id").select("*", *now)
            return rows.withColumn("metadata", merged(F.col("metadata"), F.col("told"))).drop("told")

        self.change(build)

    def expire(self, now: str, seconds: float = 30.0) -> int:
        """Online agents that were silent for longer turn unhealthy; how many. Busy ones never do."""
        silent = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_heartbeat") > int(seconds * 1e6)
        return self.change(lambda have: have.where((F.col("status") == "online") & silent).withColumn("status", F.lit("unhealthy"))).count()
