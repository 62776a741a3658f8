"""Task queue and agents: order, admission, matching, state and statistics."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Weight of a step of priority, and the statuses.
PRIORITY_WEIGHT = 1_000_000
STATUSES = ("pending", "queued", "running", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")


def dequeue_rank(tasks: DataFrame, status: str = "queued") -> DataFrame:
    """Queued tasks with their place in line: higher priority, then older, then smaller id.

    A global order needs no single task: rows are range-partitioned and counted (``vectors.with_index_ids`` does the
    same); here the order key is the compound of the three.
    """
    from contextloom.operators.vectors import with_index_ids

    queued = tasks.where(F.col("status") == status)
    key = F.struct((-F.col("priority")).alias("p"), "created_at", "task_id")
    ranked = with_index_ids(queued.withColumn("_order", key), 1, "_order", "queue_rank")
    return ranked.drop("_order")


def score_order(priority: Column, created: Column) -> Column:
    """The sorted-set score in which a step of priority is worth 11.6 days of age."""
    return -priority * PRIORITY_WEIGHT + F.unix_micros(created.cast("timestamp")) / 1e6


def can_do(required: Column, offered: Column) -> Column:
    """Every required capability is offered; an empty list on either side fits all."""
    return (F.size(required) == 0) | (F.size(offered) == 0) | (F.size(F.array_except(required, offered)) == 0)


def agents_for_tasks(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """task_id and the number of agents that can do it, by relational division on the distinct sets of capabilities.

    Tasks and agents never meet row by row: distinct sets do, on the capabilities they share.
    """
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    t = tasks.select("task_id", key("required_capabilities").alias("req"), F.array_distinct("required_capabilities").alias("r"))
    wanted = t.where(F.size("r") > 0).select("req", F.size("r").alias("n"), "r").dropDuplicates(["req"])
    offers = agents.select(key("capabilities").alias("cap"), F.array_distinct("capabilities").alias("c")).groupBy("cap").agg(F.first("c").alias("c"), F.count(F.lit(1)).alias("agents"))
    pairs = wanted.select("req", "n", F.explode("r").alias("x")).join(offers.select("cap", "agents", F.explode("c").alias("x")), "x")
    fit = pairs.groupBy("req", "cap", "n", "agents").agg(F.count(F.lit(1)).alias("k")).where("k = n").groupBy("req").agg(F.sum("agents").alias("fit"))
    all_agents, empty = offers.agg(F.sum("agents"), F.sum(F.when(F.size("c") == 0, F.col("agents")))).first()  # two numbers
    out = t.join(fit, "req", "left")
    n = F.when(F.col("req") == "", F.lit(all_agents or 0)).otherwise(F.coalesce("fit", F.lit(0)) + F.lit(empty or 0))
    return out.select("task_id", n.cast("long").alias("n_agents"))


def agents_by_capability(agents: DataFrame) -> DataFrame:
    """Online agents of each capability."""
    return agents.where("status = 'online'").select(F.explode("capabilities").alias("capability"), "agent_id").groupBy("capability").agg(F.count(F.lit(1)).alias("n_agents"), F.min("agent_id").alias("first_agent"))


def updated_load(agents: DataFrame, changes: DataFrame) -> DataFrame:
    """current_tasks after the changes (agent_id, delta), never below 0."""
    delta = changes.groupBy("agent_id").agg(F.sum("delta").alias("delta"))
    n = F.greatest(F.lit(0).cast("long"), F.col("current_tasks") + F.coalesce("delta", F.lit(0)))
    return agents.join(delta, "agent_id", "left").select("agent_id", n.cast("long").alias("current_tasks"))


def least_loaded(agents: DataFrame) -> DataFrame:
    """For each capability the free online agent with the fewest tasks; of equals the first registered."""
    free = agents.where("status = 'online' and current_tasks < max_concurrent_tasks")
    rows = free.select(F.explode("capabilities").alias("capability"), "agent_id", "current_tasks", "registered_at")
    return rows.groupBy("capability").agg(F.min_by("agent_id", F.struct("current_tasks", "registered_at", "agent_id")).alias("agent_id"))


def agent_stats(agents: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return agents.agg(
        F.count(F.lit(1)).alias("total"), n("online").alias("online"), n("busy").alias("busy"), n("unhealthy").alias("unhealthy"),
        (F.count(F.lit(1)) - n("online") - n("busy") - n("unhealthy")).alias("offline"), F.sum("current_tasks").cast("long").alias("current_tasks"),
    )


def task_stats(tasks: DataFrame) -> DataFrame:
    """Counts by the six statuses; the queue's size counts queued tasks only."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return tasks.agg(F.count(F.lit(1)).alias("total_tasks"), *counts, F.count_if(F.col("status") == "queued").alias("queue_size"))


def last_state(events: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """The columns of each key's last event; of events at the same time the largest values."""
    return events.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("last")).select(key, *[F.col(f"last.{c}").alias(c) for c in (at, *columns)])


def final_states(events: DataFrame) -> DataFrame:
    """Last state of each task from its events (task_id, at, event), and whether a transition was illegal.

    Completing overwrites whatever was before; cancelling a finished task is illegal and changes nothing.
    """
    w = Window.partitionBy("task_id").orderBy("at", "event")
    before = F.max(F.col("event").isin("completed", "failed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    legal = ~((F.col("event") == "cancelled") & (F.coalesce(before, F.lit(0)) == 1))
    rows = events.withColumn("legal", legal)
    return rows.groupBy("task_id").agg(
        F.max_by(F.when(F.col("legal"), F.col("event")), F.when(F.col("legal"), F.struct("at", "event"))).alias("status"), F.count_if(~F.col("legal")).alias("illegal")
    )


def duration_seconds(started: Column, completed: Column) -> Column:
    """Seconds from start to completion; 0 if either is missing."""
    return F.coalesce((F.unix_micros(completed.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1e6, F.lit(0.0))


def assignment_pass(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """One pass over the agents in order of registration: each free online one takes the first queued task it can do.

    Every choice depends on those before, so the pass is one stream over a sorted partition: tasks first, then agents.
    Only heads are needed: of each set of requirements no more tasks than there are free agents can be taken. The task
    holds these heads, an id each, and for an agent looks at one head of each set of requirements; nothing but the
    number of free agents comes to the driver.
    """
    free = agents.where("status = 'online' and current_tasks < max_concurrent_tasks")
    n_free = free.count()
    key = F.array_join(F.array_sort(F.array_distinct("required_capabilities")), ",")
    w = Window.partitionBy("req").orderBy(F.desc("priority"), "created_at", "task_id")
    heads = tasks.where("status = 'queued'").withColumn("req", key).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n_free)
    none = lambda df, c: F.lit(None).cast(dict(df.dtypes)[c]).alias(c)
    rows = heads.select(F.lit(0).alias("kind"), F.col("task_id").cast("long").alias("id"), F.col("required_capabilities").alias("c"), (-F.col("priority")).cast("long").alias("p"), "created_at", none(free, "registered_at"))
    line = free.select(F.lit(1).alias("kind"), F.col("agent_id").cast("long").alias("id"), F.col("capabilities").alias("c"), F.lit(0).cast("long").alias("p"), none(tasks, "created_at"), "registered_at")
    ordered = rows.unionByName(line).repartition(1).sortWithinPartitions("kind", "p", "created_at", "registered_at", "id").select("kind", "id", "c")

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues: dict[frozenset[str], deque[tuple[int, int]]] = {}
        fitting: dict[frozenset[str], list[frozenset[str]]] = {}
        place = 0
        for b in batches:
            out: list[tuple[int, int]] = []
            for kind, i, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = frozenset(c or [])
                if kind == 0:
                    queues.setdefault(words, deque()).append((place, i))
                    place += 1
                    continue
                if words not in fitting:  # all tasks have come by now
                    fitting[words] = [r for r in queues if not r or not words or r <= words]
                if open_ := [queues[r] for r in fitting[words] if queues[r]]:
                    out.append((min(open_, key=lambda q: q[0][0]).popleft()[1], i))
            yield pa.record_batch({"task_id": pa.array([t for t, _ in out], pa.int64()), "agent_id": pa.array([a for _, a in out], pa.int64())})

    return ordered.mapInArrow(assign, "task_id long, agent_id long")


def admitted(tasks: DataFrame, capacity: int) -> DataFrame:
    """Whether each task finds room in a bounded queue, in order of arrival."""
    from contextloom.operators.vectors import with_index_ids

    ranked = with_index_ids(tasks.withColumn("_order", F.struct("created_at", "task_id")), 1, "_order", "arrival")
    return ranked.drop("_order").withColumn("accepted", F.col("arrival") <= capacity)


def batch_outcomes(items: DataFrame, batch: str, order: str, failed: Column) -> DataFrame:
    """Per batch: successful and failed items, and how many ran if the batch stops at its first failure."""
    rows = items.withColumn("_failed", failed.cast("int"))
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_ran", F.coalesce(F.max("_failed").over(w), F.lit(0)) == 0)
    return rows.groupBy(batch).agg(F.count_if(F.col("_failed") == 0).alias("successful"), F.count_if(F.col("_failed") == 1).alias("failed"), F.count_if("_ran").alias("ran_until_error"))
