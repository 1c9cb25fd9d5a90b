"""Registered lifecycle / operations queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import extraction as X
from pagefold.operators import ops as O
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.plans.q_extract import SQL_RUN_ITEMS, _dq_sql
from pagefold.sources import derived as S

SNAPSHOT_AT = "2024-01-15 12:00:00"

SQL_RUNS = """
runs AS (
  SELECT 'run-' || CAST(event_id AS VARCHAR) AS run_id, 'plan-' || CAST(user_id AS VARCHAR) AS plan_id,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
         ts AS start_time, make_timestamp(epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT)) AS end_time,
         CAST(floor(value) AS BIGINT) AS items_extracted, event_id % 3 + 1 AS pages_processed,
         CAST(round(value * 1000) AS BIGINT) AS duration_ms,
         CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS errors_encountered,
         CASE WHEN event_type = 'error' THEN 'Selector timeout on page ' || CAST(event_id % 3 + 1 AS VARCHAR) END AS error_message,
         event_type, user_id
  FROM events
)"""


def _runs(spark, sf_dir):
    return S.executions(spark, sf_dir)


def _rf(x: str, d: int) -> str:
    m = 10 ** d
    return f"floor(({x}) * {m}.0e0 + 0.5e0) / {m}.0e0"


@register("plan_metrics", oracle=f"""
WITH {SQL_RUNS},
g AS (
  SELECT plan_id, count(*) AS total_executions,
         count(*) FILTER (WHERE status = 'completed') AS successful_executions,
         count(*) FILTER (WHERE status = 'failed') AS failed_executions,
         sum(items_extracted) AS total_items_extracted, sum(pages_processed) AS total_pages_processed,
         sum(duration_ms) AS total_duration, sum(errors_encountered) AS total_errors,
         arg_max(run_id, (end_time, run_id)) AS last_execution_id, arg_max(status, (end_time, run_id)) AS last_execution_status
  FROM runs GROUP BY plan_id
)
SELECT *, {_rf('successful_executions / total_executions * 100', 2)} AS success_rate,
       {_rf('total_items_extracted / total_executions', 2)} AS avg_items_per_execution,
       {_rf('total_duration / total_executions', 0)} AS avg_duration,
       {_rf('total_pages_processed / total_executions', 2)} AS avg_pages_per_execution,
       {_rf('total_errors / total_executions * 100', 2)} AS error_rate
FROM g""")
def plan_metrics(spark, sf_dir):
    return O.plan_metrics(_runs(spark, sf_dir))


@register("global_metrics", oracle=f"""
WITH {SQL_RUNS}
SELECT count(DISTINCT plan_id) AS total_plans, count(*) AS total_executions, sum(items_extracted) AS total_items_extracted
FROM runs""")
def global_metrics(spark, sf_dir):
    return O.global_metrics(_runs(spark, sf_dir))


@register("plan_history_topn", oracle=f"""
WITH {SQL_RUNS}
SELECT plan_id, run_id, status, items_extracted, pages_processed, duration_ms, errors_encountered, rank,
       rank <= 50 AS in_status FROM (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY end_time DESC, run_id DESC) AS rank FROM runs)
WHERE rank <= 100""")
def plan_history_topn(spark, sf_dir):
    return O.plan_history_topn(_runs(spark, sf_dir), 100, 50)


@register("execution_errors", oracle=f"""
WITH {SQL_RUNS}
SELECT CASE WHEN status = 'failed' THEN 'EXECUTION_FAILURE' ELSE 'EXECUTION_ERROR' END AS error_type,
       error_message AS message, count(*) AS count
FROM runs WHERE error_message IS NOT NULL GROUP BY 1, 2""")
def execution_errors(spark, sf_dir):
    return O.execution_errors(_runs(spark, sf_dir))


@register("confidence_filter", oracle=f"""
WITH {SQL_RUN_ITEMS}
SELECT run_key AS plan_id, round(conf, 9) AS confidence_score FROM (
  SELECT run_key, sum({_dq_sql()}) / (count(*) * 5.0e0) AS conf FROM run_items GROUP BY run_key)
WHERE conf >= 0.7""")
def confidence_filter(spark, sf_dir):
    """Plans (one per site) whose confidence -- the site's data quality --
    reaches the default threshold 0.7."""
    from pagefold.functions import url as U
    it = S.items(spark, sf_dir).withColumn("run_key", U.url_host("sourceUrl"))
    plans = X.data_quality(it, "run_key").select(F.col("run_key").alias("plan_id"),
                                                 F.col("data_quality").alias("confidence_score"))
    return O.confidence_filter(plans, 0.7).select("plan_id", F.round("confidence_score", 9).alias("confidence_score"))


SQL_STEPS = f"""{SQL_RUNS},
steps AS (
  SELECT plan_id || '@' || strftime(start_time, '%Y-%m-%d') AS workflow_id, event_type AS type, run_id AS step_id,
         row_number() OVER w AS ord, CASE WHEN status = 'failed' THEN 'failed' ELSE 'completed' END AS status,
         start_time AS started_at, lead(start_time) OVER w AS completed_at
  FROM runs WINDOW w AS (PARTITION BY plan_id || '@' || strftime(start_time, '%Y-%m-%d') ORDER BY start_time, run_id)
),
steps2 AS (
  SELECT *, CASE WHEN coalesce(max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY workflow_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1
                 THEN 'skipped' ELSE status END AS eff_status
  FROM steps
)"""


@register("workflow_step_durations", oracle=f"""
WITH {SQL_STEPS}
SELECT type, count(*) FILTER (WHERE eff_status <> 'skipped') AS executed,
       count(*) FILTER (WHERE eff_status = 'failed') AS failed,
       count(*) FILTER (WHERE eff_status = 'skipped') AS skipped,
       round(avg(CASE WHEN eff_status = 'completed' THEN (epoch_us(completed_at) - epoch_us(started_at)) / 1000000.0e0 END), 6) AS avg_seconds
FROM steps2 GROUP BY type""")
def workflow_step_durations(spark, sf_dir):
    d = O.workflow_step_durations(O.workflow_steps(_runs(spark, sf_dir)))
    return d.withColumn("avg_seconds", F.round("avg_seconds", 6))


@register("plan_status_latest", oracle=f"""
WITH {SQL_RUNS},
t AS (SELECT plan_id, start_time AS ts, 1 AS k, 'executing' AS status, run_id FROM runs
      UNION ALL SELECT plan_id, end_time, 2, status, run_id FROM runs)
SELECT plan_id, arg_max(status, (ts, k, run_id)) AS status,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS created_at,
       count(*) AS transitions
FROM t GROUP BY plan_id""")
def plan_status_latest(spark, sf_dir):
    g = O.plan_status_latest(_runs(spark, sf_dir))
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return g.select("plan_id", "status", F.date_format("updated_at", fmt).alias("updated_at"),
                    F.date_format("created_at", fmt).alias("created_at"), "transitions")


@register("queue_snapshot", oracle=f"""
WITH {SQL_RUNS}
SELECT count(*) FILTER (WHERE start_time <= TIMESTAMP '{SNAPSHOT_AT}' AND end_time > TIMESTAMP '{SNAPSHOT_AT}') AS active_workflows,
       count(*) FILTER (WHERE start_time > TIMESTAMP '{SNAPSHOT_AT}') AS queued_executions
FROM runs""")
def queue_snapshot(spark, sf_dir):
    return O.queue_snapshot(_runs(spark, sf_dir), F.to_timestamp(F.lit(SNAPSHOT_AT)))


@register("runs_browse", oracle=f"""
WITH {SQL_RUNS}
SELECT run_id, plan_id, status FROM runs
WHERE (contains(lower(run_id), 'run-1') OR contains(lower(plan_id), 'run-1')) AND contains(plan_id, 'plan-1')
ORDER BY start_time DESC NULLS LAST, run_id DESC LIMIT 10 OFFSET 10""")
def runs_browse(spark, sf_dir):
    """Second page of runs matching 'RUN-1' (case-insensitive) on plans containing 'plan-1'."""
    return O.runs_browse(_runs(spark, sf_dir), search="RUN-1", plan="plan-1", page=2).select(
        "run_id", "plan_id", "status")


#: Plans with their site, runs and tasks as summaries; plans of every third site were never run and have no date.
SQL_SUMMARIES = SQL_RUNS + f""",
first_run AS (SELECT plan_id, min(start_time) AS created_at FROM runs GROUP BY plan_id),
plan_site AS (SELECT DISTINCT page_id, url FROM pages),
task_log AS (SELECT 'task-' || CAST(user_id % 20 AS VARCHAR) AS task_id, ts, event_id, value > 49.5 AND event_type = 'purchase' AS done,
    value > 49.5 AND event_type = 'error' AS bad FROM events),
summary AS (
  SELECT 'plan' AS kind, 'plan-' || page_id AS id, {D.host('url')} || ' ' || url AS label, created_at AS started_at, CAST(NULL AS VARCHAR) AS status
  FROM plan_site LEFT JOIN first_run ON plan_id = 'plan-' || page_id
  UNION ALL SELECT 'run', run_id, run_id || ' ' || plan_id, start_time, status FROM runs
  UNION ALL SELECT 'task', task_id, task_id, min(ts), CASE arg_min(done, (ts, event_id)) FILTER (WHERE done OR bad) WHEN true THEN 'completed' WHEN false THEN 'failed' ELSE 'running' END
    FROM task_log GROUP BY task_id)"""


def _summaries(spark, sf_dir):
    from pagefold.functions import url as U
    from pagefold.sources.tables import pages, read_table
    from pagefold.streaming import jobs as J
    runs = _runs(spark, sf_dir)
    first = runs.groupBy("plan_id").agg(F.min("start_time").alias("created_at"))
    plans = pages(spark, sf_dir).select(F.concat(F.lit("plan-"), F.col("page_id").cast("string")).alias("plan_id"), U.url_host("url").alias("domain"), "url")
    events = J.task_events_from(read_table(spark, sf_dir, "events"))
    began = events.groupBy("task_id").agg(F.min("ts").alias("started_at"))
    tasks = J.task_state(events).select("task_id", "status").join(began, "task_id")
    return O.summaries(plans.join(first, "plan_id", "left"), runs, tasks)


def _browse_sql(kind: str, search: str, page: int) -> str:
    return f"""
WITH {SQL_SUMMARIES}
SELECT id, status FROM summary WHERE kind = '{kind}' AND contains(lower(label), '{search}')
ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 10 OFFSET {10 * (page - 1)}"""


@register("plans_browse", oracle=_browse_sql("plan", "example.com", 2))
def plans_browse(spark, sf_dir):
    """Second page of the plans whose domain or URL contains 'Example.COM'."""
    return O.summaries_browse(_summaries(spark, sf_dir), "plan", "Example.COM", 2).select("id", "status")


@register("tasks_browse", oracle=_browse_sql("task", "task-1", 1))
def tasks_browse(spark, sf_dir):
    """The newest tasks whose name contains 'task-1'."""
    return O.summaries_browse(_summaries(spark, sf_dir), "task", "task-1").select("id", "status")


@register("dashboard_summary", oracle=f"""
WITH {SQL_SUMMARIES},
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY started_at DESC NULLS LAST, id DESC) AS n FROM summary)
SELECT kind, count(*) AS total, count(*) FILTER (WHERE status IN ('running', 'pending')) AS active,
  string_agg(id, ',' ORDER BY n) FILTER (WHERE n <= 5) AS newest FROM r GROUP BY kind""")
def dashboard_summary(spark, sf_dir):
    """Totals, active counts and the newest five plans, runs and tasks."""
    return O.dashboard(_summaries(spark, sf_dir)).withColumn("newest", F.array_join("newest", ","))
