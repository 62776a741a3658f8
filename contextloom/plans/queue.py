"""Queries over tasks, agents, heartbeats and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.operators import limits as L
from contextloom.operators import maps as M
from contextloom.operators import tasks as T
from contextloom.plans.frames import AGENTS, NOW, TASKS, agents, sql, table, tasks
from contextloom.streaming import events as E

SQL: dict[str, str] = {}


def tasks_by_status(spark: SparkSession, d: str) -> DataFrame:
    return tasks(spark, d).where("status = 'running'").select("task_id", "priority", "created_at")


SQL["tasks_by_status"] = sql(TASKS, body="SELECT task_id, priority, created_at FROM tasks WHERE status = 'running'")


def tasks_recent(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest: the limit is the feature."""
    return tasks(spark, d).orderBy(F.desc("created_at"), "task_id").limit(100).select("task_id", "created_at")


SQL["tasks_recent"] = sql(TASKS, body="SELECT task_id, created_at FROM tasks ORDER BY created_at DESC, task_id LIMIT 100")


def task_dequeue_order(spark: SparkSession, d: str) -> DataFrame:
    return T.dequeue_rank(tasks(spark, d)).select("task_id", "queue_rank")


SQL["task_dequeue_order"] = sql(TASKS, body="SELECT task_id, row_number() OVER (ORDER BY priority DESC, created_at, task_id) AS queue_rank FROM tasks WHERE status = 'queued'")


def task_dequeue_scored(spark: SparkSession, d: str) -> DataFrame:
    """The first ten by score, whatever their status, of which the queued ones can be taken."""
    score = T.score_order(F.col("priority"), F.col("created_at"))
    head = tasks(spark, d).select("task_id", "status", score.alias("score")).orderBy("score", "task_id").limit(10)
    return head.where("status = 'queued'").select("task_id", "score")


SQL["task_dequeue_scored"] = sql(
    TASKS, "h AS (SELECT task_id, status, -priority * 1000000 + epoch_us(created_at) / 1e6 AS score FROM tasks ORDER BY 3, 1 LIMIT 10)",
    body="SELECT task_id, score FROM h WHERE status = 'queued'",
)


def task_status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return T.task_stats(tasks(spark, d))


COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in T.STATUSES)
SQL["task_status_pivot"] = sql(TASKS, body=f"SELECT count(*) AS total_tasks, {COUNTS}, count(*) FILTER (status = 'queued') AS queue_size FROM tasks")


def task_duration(spark: SparkSession, d: str) -> DataFrame:
    """Order date as start, the last line's ship date as completion."""
    done = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("completed_at"))
    rows = tasks(spark, d).join(done, F.col("task_id") == F.col("l_orderkey"), "left")
    return rows.select("task_id", T.duration_seconds(F.col("created_at"), F.col("completed_at")).alias("seconds"))


SQL["task_duration"] = sql(
    TASKS, "done AS (SELECT l_orderkey, max(l_shipdate) AS completed_at FROM lineitem GROUP BY 1)",
    body="SELECT task_id, coalesce((epoch_us(completed_at) - epoch_us(created_at)) / 1e6, 0.0) AS seconds FROM tasks LEFT JOIN done ON task_id = l_orderkey",
)


def task_events(spark: SparkSession, d: str) -> DataFrame:
    """Lines as events of their order: cancelled, completed or failed, by flag, at their ship date."""
    kind = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "O", "cancelled").otherwise("completed")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.struct("l_shipdate", "l_linenumber").alias("at"), kind.alias("event"))


def task_final_state(spark: SparkSession, d: str) -> DataFrame:
    return T.final_states(task_events(spark, d))


SQL["task_final_state"] = """WITH e AS (SELECT l_orderkey AS task_id, l_shipdate AS d, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' THEN 'cancelled' ELSE 'completed' END AS event FROM lineitem),
f AS (SELECT *, NOT (event = 'cancelled' AND coalesce(max((event IN ('completed', 'failed'))::INT) OVER (PARTITION BY task_id ORDER BY d, n, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1) AS legal FROM e)
SELECT task_id, max_by(event, (d, n, event)) FILTER (legal) AS status, count(*) FILTER (NOT legal) AS illegal FROM f GROUP BY task_id"""


def task_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """What is left once finished tasks that are older than a day at the given time are gone."""
    cutoff = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    old = F.col("status").isin(*T.TERMINAL) & (F.col("created_at") < cutoff)
    return tasks(spark, d).where(~old).groupBy("status").agg(F.count(F.lit(1)).alias("n_left"), F.min("created_at").alias("oldest"))


SQL["task_cleanup"] = sql(TASKS, body="SELECT status, count(*) AS n_left, min(created_at) AS oldest FROM tasks WHERE NOT (status IN ('completed', 'failed', 'cancelled') AND created_at < TIMESTAMP '1996-01-01' - INTERVAL 24 HOUR) GROUP BY status")


def queue_admission(spark: SparkSession, d: str) -> DataFrame:
    return T.admitted(tasks(spark, d), 10_000).select("task_id", "accepted")


SQL["queue_admission"] = sql(TASKS, body="SELECT task_id, row_number() OVER (ORDER BY created_at, task_id) <= 10000 AS accepted FROM tasks")


def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("line", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return T.batch_outcomes(lines, "l_orderkey", "line", F.col("l_returnflag") == "R")


SQL["batch_outcomes"] = """WITH r AS (SELECT *, coalesce(max((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ran FROM lineitem)
SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS successful, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (ran) AS ran_until_error FROM r GROUP BY 1"""


def capability_match(spark: SparkSession, d: str) -> DataFrame:
    return T.agents_for_tasks(tasks(spark, d), agents(spark, d))


SQL["capability_match"] = sql(
    TASKS, AGENTS, "t AS (SELECT DISTINCT required_capabilities AS r FROM tasks)",
    "m AS (SELECT r, count(*) AS n FROM t JOIN agents ON len(r) = 0 OR len(capabilities) = 0 OR list_has_all(capabilities, r) GROUP BY r)",
    body="SELECT task_id, coalesce(n, 0) AS n_agents FROM tasks LEFT JOIN m ON required_capabilities = r",
)


def agents_by_capability(spark: SparkSession, d: str) -> DataFrame:
    return T.agents_by_capability(agents(spark, d))


SQL["agents_by_capability"] = sql(AGENTS, body="SELECT capability, count(*) AS n_agents, min(agent_id) AS first_agent FROM (SELECT unnest(capabilities) AS capability, agent_id FROM agents WHERE status = 'online') GROUP BY 1")


def agent_load_update(spark: SparkSession, d: str) -> DataFrame:
    """Completed orders take a task from the agent that their customer's key names."""
    n_agents = table(spark, d, "supplier").count()
    changes = tasks(spark, d).where("status = 'completed'").select((F.col("owner") % n_agents + 1).alias("agent_id"), F.lit(-1).alias("delta"))
    return T.updated_load(agents(spark, d), changes)


SQL["agent_load_update"] = sql(
    TASKS, AGENTS, "c AS (SELECT owner % (SELECT count(*) FROM supplier) + 1 AS agent_id, -count(*) AS delta FROM tasks WHERE status = 'completed' GROUP BY 1)",
    body="SELECT agent_id, greatest(0, current_tasks + coalesce(delta, 0))::BIGINT AS current_tasks FROM agents LEFT JOIN c USING (agent_id)",
)


def agent_stats(spark: SparkSession, d: str) -> DataFrame:
    return T.agent_stats(agents(spark, d))


A_COUNTS = "count(*) AS total, count(*) FILTER (status = 'online') AS online, count(*) FILTER (status = 'busy') AS busy, count(*) FILTER (status = 'unhealthy') AS unhealthy, count(*) FILTER (status NOT IN ('online', 'busy', 'unhealthy')) AS offline, sum(current_tasks)::BIGINT AS current_tasks"
SQL["agent_stats"] = sql(AGENTS, body=f"SELECT {A_COUNTS} FROM agents")


def coordinator_stats(spark: SparkSession, d: str) -> DataFrame:
    """Both one-row statistics side by side."""
    return T.agent_stats(agents(spark, d)).withColumn("one", F.lit(1)).join(T.task_stats(tasks(spark, d)).withColumn("one", F.lit(1)), "one").drop("one")


SQL["coordinator_stats"] = sql(TASKS, AGENTS, body=f"SELECT * FROM (SELECT {A_COUNTS} FROM agents), (SELECT count(*) AS total_tasks, {COUNTS}, count(*) FILTER (status = 'queued') AS queue_size FROM tasks)")


def least_loaded_agent(spark: SparkSession, d: str) -> DataFrame:
    return T.least_loaded(agents(spark, d))


SQL["least_loaded_agent"] = sql(AGENTS, body="SELECT capability, min_by(agent_id, (current_tasks, registered_at, agent_id)) AS agent_id FROM (SELECT unnest(capabilities) AS capability, * FROM agents WHERE status = 'online' AND current_tasks < max_concurrent_tasks) GROUP BY 1")


def task_assignment_pass(spark: SparkSession, d: str) -> DataFrame:
    """One greedy pass over the free agents; each choice depends on those before."""
    return T.assignment_pass(tasks(spark, d), agents(spark, d))


SQL["task_assignment_pass"] = sql(
    "RECURSIVE " + TASKS, AGENTS,
    "a AS (SELECT agent_id, capabilities AS c, row_number() OVER (ORDER BY registered_at, agent_id) AS k FROM agents WHERE status = 'online' AND current_tasks < max_concurrent_tasks)",
    "w AS (SELECT task_id, required_capabilities AS r, row_number() OVER (ORDER BY priority DESC, created_at, task_id) AS p FROM tasks WHERE status = 'queued')",
    "q AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p) AS n FROM w QUALIFY n <= (SELECT count(*) FROM a))",
    """s(k, agent_id, p, taken) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[]
  UNION ALL SELECT a.k, a.agent_id, min(q.p), list_append(s.taken, coalesce(min(q.p), -1))
  FROM s JOIN a ON a.k = s.k + 1 LEFT JOIN q ON (len(q.r) = 0 OR len(a.c) = 0 OR list_has_all(a.c, q.r)) AND NOT list_contains(s.taken, q.p)
  GROUP BY a.k, a.agent_id, s.taken)""",
    body="SELECT w.task_id, s.agent_id FROM s JOIN w ON w.p = s.p",
)


def last_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    return T.last_state(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


SQL["last_heartbeat"] = "SELECT user_id, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"


def heartbeat_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Users as agents, their events as heartbeats with metadata: what is known of each in the end, as text."""
    props = F.from_json("props", "map<string,string>")
    beats = table(spark, d, "events").select("user_id", "ts", "event_id", F.map_concat(props, F.create_map(F.col("event_type"), F.when(F.col("event_id") % 7 > 0, F.round("value", 2).cast("string")))).alias("meta"))
    known = F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return M.merged_maps(beats, "user_id", "ts", "meta", "event_id").select("user_id", F.array_join(known, ",").alias("metadata"))


SQL["heartbeat_metadata"] = """WITH e AS (SELECT user_id, ts, event_id, event_type AS k, CASE WHEN event_id % 7 > 0 THEN round(value, 2)::VARCHAR END AS v FROM events
  UNION ALL SELECT user_id, ts, event_id, 'k', props->>'k' FROM events WHERE props->>'k' IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS n FROM e)
SELECT user_id, string_agg(k || '=' || coalesce(v, 'null'), ',' ORDER BY k) AS metadata FROM l WHERE n = 1 GROUP BY user_id"""


def running_processes(spark: SparkSession, d: str) -> DataFrame:
    """Events as starts and ends of users' processes on seven machines that track ten each: what falls out, and how many run."""
    rows = table(spark, d, "events").select((F.col("user_id") % 7).alias("machine"), "event_id", "user_id", "event_type")
    return M.bounded(rows, "machine", "event_id", "user_id", F.col("event_type").isin("click", "view", "signup"), 10)


SQL["running_processes"] = """WITH l AS (SELECT user_id % 7 AS machine, list({'id': event_id, 'u': user_id, 's': event_type IN ('click', 'view', 'signup')} ORDER BY event_id) AS rows FROM events GROUP BY 1),
f AS (SELECT machine, list_reduce(rows, lambda a, x: {'now': CASE WHEN NOT x.s THEN list_filter(a.now, lambda k: k <> x.u) WHEN list_contains(a.now, x.u) THEN a.now
      ELSE list_append(CASE WHEN len(a.now) >= 10 THEN a.now[2:] ELSE a.now END, x.u) END,
    'out': list_append(a.out, {'id': x.id, 'evicted': CASE WHEN x.s AND NOT list_contains(a.now, x.u) AND len(a.now) >= 10 THEN a.now[1] END,
      'held': (len(a.now) + CASE WHEN NOT x.s THEN -list_contains(a.now, x.u)::INT WHEN list_contains(a.now, x.u) OR len(a.now) >= 10 THEN 0 ELSE 1 END)::INT})},
  {'now': []::BIGINT[], 'out': []::STRUCT(id BIGINT, evicted BIGINT, held INT)[]}) AS r FROM l),
u AS (SELECT machine, unnest(r.out) AS o FROM f)
SELECT machine, o.id AS event_id, o.evicted AS evicted, o.held AS held FROM u"""


def unhealthy_agents(spark: SparkSession, d: str) -> DataFrame:
    """Silent for a day at the given time; users of odd id are busy and never expire."""
    rows = T.last_state(table(spark, d, "events"), "user_id", "ts")
    silent = F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > 30 * 3600 * 1_000_000
    return rows.select("user_id", (silent & (F.col("user_id") % 2 == 0)).alias("unhealthy"))


SQL["unhealthy_agents"] = f"SELECT user_id, user_id % 2 = 0 AND TIMESTAMP '{NOW}' - max(ts) > INTERVAL 30 HOUR AS unhealthy FROM events GROUP BY user_id"


def request_rate_1m(spark: SparkSession, d: str) -> DataFrame:
    """Requests in the ten hours up to each."""
    return L.request_rates(table(spark, d, "events"), "user_id", "ts", 36_000).select("event_id", "in_window")


SQL["request_rate_1m"] = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW) AS in_window FROM events"


def rate_limit_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Three requests in ten hours: each decision depends on those before."""
    return L.rate_decisions(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 36_000)


SQL["rate_limit_decisions"] = """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
s(client, k, request_id, allowed, log) AS (SELECT user_id, k, event_id, true, [t] FROM o WHERE k = 1
  UNION ALL SELECT client, k, event_id, len(recent) < 3, CASE WHEN len(recent) < 3 THEN list_append(recent, t) ELSE recent END
  FROM (SELECT s.client, o.k, o.event_id, o.t, list_filter(s.log, lambda x: x > o.t - 36000000000) AS recent FROM s JOIN o ON o.user_id = s.client AND o.k = s.k + 1))
SELECT client, request_id, allowed FROM s"""


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.tumbling(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


SQL["events_tumbling"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(rows, "6 hours").withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


SQL["events_sessions"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k"""


def api_key_semi(spark: SparkSession, d: str) -> DataFrame:
    """Requests of known clients."""
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


SQL["api_key_semi"] = "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"

QUERIES = {
    f.__name__: f
    for f in (
        tasks_by_status, tasks_recent, task_dequeue_order, task_dequeue_scored, task_status_pivot, task_duration, task_final_state, task_cleanup,
        queue_admission, batch_outcomes, capability_match, agents_by_capability, agent_load_update, agent_stats, coordinator_stats, least_loaded_agent,
        task_assignment_pass, last_heartbeat, heartbeat_metadata, running_processes, unhealthy_agents, request_rate_1m, rate_limit_decisions, events_tumbling, events_sessions, api_key_semi,
    )
}
