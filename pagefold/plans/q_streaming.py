"""Registered streaming queries.

Each runs an actual Structured Streaming query to completion (``availableNow``)
over the table's files into the shared checkpoint folder and returns what it
wrote; ``consent_ttl_reuse`` is the batch form of the expiring cache.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import ops as O
from pagefold.operators import quality as Q
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.plans.q_compliance import SQL_ROBOTS
from pagefold.plans.q_items import SQL_ITEMS, SQL_PAGE_ITEMS, SQL_VALIDATED
from pagefold.plans.q_ops import SQL_RUNS
from pagefold.sources import derived as S
from pagefold.sources.tables import read_table
from pagefold.streaming import jobs as J

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PAGES_SCHEMA = "page_id long, url string, html string"

SQL_TASK_EVENTS = """
task_events AS (
  SELECT 'task-' || CAST(user_id % 20 AS VARCHAR) AS task_id, ts, event_id,
    CASE WHEN value > 49.5 AND event_type = 'purchase' THEN 'complete'
         WHEN value > 49.5 AND event_type = 'error' THEN 'error' ELSE 'log' END AS type,
    CASE WHEN value > 49.5 AND event_type = 'purchase' THEN '0' WHEN value > 49.5 AND event_type = 'error' THEN '1'
         WHEN event_type = 'view' THEN 'Initializing browser for ' || props
         WHEN event_type = 'click' THEN 'Analyzing page ' || CAST(event_id AS VARCHAR)
         WHEN event_type = 'signup' THEN 'Plan ID: plan-' || CAST(user_id AS VARCHAR) || ' saved to: plans/plan-'
              || CAST(user_id AS VARCHAR) || '.md'
         WHEN event_type = 'purchase' THEN 'Items extracted: ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
         ELSE 'Results saved to: results/run-' || CAST(event_id AS VARCHAR) || '.json' END AS data
  FROM events
)"""


def _prog_sql() -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains(data, {D.q(w)})' for w in words)} THEN {p}"
                     for words, p in J.PROGRESS_RULES)
    return f"CASE {whens} END"


SQL_PARSED = SQL_TASK_EVENTS + f""",
parsed AS (
  SELECT task_id, ts, event_id, data, {_prog_sql()} AS progress,
    {', '.join(f"nullif(regexp_extract(data, {D.q(p)}, 1), '') AS {k}" for k, p in J.OUTPUT_PATTERNS.items())}
  FROM task_events WHERE type = 'log'
)"""


def _task_events(spark, sf_dir):
    return J.task_events_from(read_table(spark, sf_dir, "events"))


def _task_event_stream(spark, sf_dir):
    return J.task_events_from(J.stream_source(spark, sf_dir, "events", EVENTS_SCHEMA))


@register("stream_log_parse", oracle=f"WITH {SQL_PARSED} SELECT * FROM parsed")
def stream_log_parse(spark, sf_dir):
    out = J.run_available_now(J.log_parse(_task_event_stream(spark, sf_dir)), "log-parse")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _last_sql(c: str) -> str:
    return f"arg_max({c}, (ts, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}"


SQL_STATE = SQL_PARSED + f""",
st AS (
  SELECT task_id, coalesce(arg_max(progress, (ts, event_id)) FILTER (WHERE progress IS NOT NULL), 10) AS progress,
         count(*) AS n_logs, {', '.join(_last_sql(k) for k in J.OUTPUT_PATTERNS)}
  FROM parsed GROUP BY task_id
),
closes AS (
  SELECT task_id, arg_min(CAST(data AS INTEGER), (ts, event_id)) AS exit_code, min(ts) AS closed_at
  FROM task_events WHERE type IN ('complete', 'error') GROUP BY task_id
),
state AS (
  SELECT coalesce(st.task_id, closes.task_id) AS task_id, coalesce(n_logs, 0) AS n_logs,
    {', '.join(k for k in J.OUTPUT_PATTERNS)},
    CASE WHEN exit_code = 0 THEN 'completed' WHEN exit_code IS NOT NULL THEN 'failed' ELSE 'running' END AS status,
    CASE WHEN exit_code = 0 THEN 100 ELSE coalesce(progress, 10) END AS progress,
    CASE WHEN exit_code <> 0 THEN 'Process exited with code ' || CAST(exit_code AS VARCHAR) END AS error
  FROM st FULL OUTER JOIN closes ON st.task_id = closes.task_id
)"""


@register("stream_task_state", oracle=f"WITH {SQL_STATE} SELECT * FROM state")
def stream_task_state(spark, sf_dir):
    return J.run_available_now(J.task_state(_task_event_stream(spark, sf_dir)), "task-state", "update", key=["task_id"])


@register("stream_snapshot_then_updates", oracle=f"""
WITH {SQL_STATE}
SELECT p.task_id, p.event_id, p.progress AS line_progress, s.status AS snapshot_status, s.n_logs AS snapshot_logs
FROM parsed p LEFT JOIN state s USING (task_id)""")
def stream_snapshot_then_updates(spark, sf_dir):
    """Stream-static join: a new reader's lines, each with the task-state
    snapshot that it was sent first."""
    snap = J.task_state(_task_events(spark, sf_dir)).select(
        "task_id", F.col("status").alias("snapshot_status"), F.col("n_logs").alias("snapshot_logs"))
    lines = J.log_parse(_task_event_stream(spark, sf_dir))
    return J.run_available_now(lines.join(snap, "task_id", "left").select(
        "task_id", "event_id", F.col("progress").alias("line_progress"), "snapshot_status", "snapshot_logs"), "snapshot")


@register("stream_terminal", oracle=f"""
WITH {SQL_TASK_EVENTS}
SELECT task_id, arg_min(CAST(data AS INTEGER), (ts, event_id)) AS exit_code
FROM task_events WHERE type IN ('complete', 'error') GROUP BY task_id""")
def stream_terminal(spark, sf_dir):
    """Earliest close per task, upserted as the stream goes on."""
    out = J.run_available_now(J.terminal(_task_event_stream(spark, sf_dir)), "terminal", "update", key=["task_id"])
    return out.select("task_id", "exit_code")


@register("stream_ops_window", oracle=f"""
WITH {SQL_RUNS}
SELECT time_bucket(INTERVAL 60 SECOND, start_time) AS window_start, count(*) AS runs,
       count(*) FILTER (WHERE status = 'failed') AS failed, sum(items_extracted) AS items
FROM runs GROUP BY 1""")
def stream_ops_window(spark, sf_dir):
    runs = S.executions_from(J.stream_source(spark, sf_dir, "events", EVENTS_SCHEMA))
    out = J.run_available_now(J.ops_window(runs), "ops-window", "update", key=["window_start"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("stream_plan_metrics", oracle=f"""
WITH {SQL_RUNS},
m AS (SELECT plan_id, count(*) AS total_executions, count(*) FILTER (WHERE status = 'completed') AS successful_executions,
             sum(items_extracted) AS total_items_extracted FROM runs GROUP BY plan_id)
SELECT *, floor(successful_executions / total_executions * 100 * 100 + 0.5) / 100 AS success_rate FROM m""")
def stream_plan_metrics(spark, sf_dir):
    """Running per-plan totals from a stream of finished runs (update mode:
    a micro-batch writes only the plans that it changed)."""
    runs = S.executions_from(J.stream_source(spark, sf_dir, "events", EVENTS_SCHEMA))
    agg = runs.groupBy("plan_id").agg(F.count("*").alias("total_executions"),
                                      F.count_if(F.col("status") == "completed").alias("successful_executions"),
                                      F.sum("items_extracted").alias("total_items_extracted"))
    out = J.run_available_now(agg, "plan-metrics", "update", key=["plan_id"])
    return out.withColumn("success_rate", O.round_fixed(
        F.col("successful_executions") / F.col("total_executions") * 100, 2))


@register("stream_page_ingest", oracle=f"""
WITH {SQL_PAGE_ITEMS},
items AS (
  SELECT item_id, title, CAST(NULL AS VARCHAR) AS place, description, CAST(NULL AS VARCHAR) AS address,
    CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone, website, CAST(NULL AS DOUBLE) AS price,
    CAST(NULL AS DOUBLE) AS discountPrice, CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS DOUBLE) AS latitude,
    CAST(NULL AS VARCHAR) AS startDate, CAST(NULL AS VARCHAR) AS endDate, CAST([] AS VARCHAR[]) AS dates,
    CAST(NULL AS VARCHAR) AS createdAt, CAST(NULL AS INTEGER) AS zipcode, images, language, sourceUrl
  FROM page_items){SQL_VALIDATED[len(SQL_ITEMS):]}
SELECT item_id, is_valid, quality_score, len(errors) AS n_errors FROM validated""")
def stream_page_ingest(spark, sf_dir):
    """Pages arriving as files are extracted and validated per micro-batch."""
    src = J.stream_source(spark, sf_dir, "pages", PAGES_SCHEMA)

    def extract(df, epoch):
        items = S.page_items(df)
        base = {k: F.lit(None).cast(t) for k, t in [("place", "string"), ("address", "string"), ("email", "string"),
                                                     ("phone", "string"), ("price", "double"),
                                                     ("discountPrice", "double"), ("longitude", "double"),
                                                     ("latitude", "double"), ("startDate", "string"),
                                                     ("endDate", "string"), ("createdAt", "string"),
                                                     ("zipcode", "int")]}
        items = items.select("*", *[v.alias(k) for k, v in base.items()]).withColumn(
            "dates", F.array().cast("array<string>"))
        v = Q.validate_items(items)
        return v.select("item_id", "is_valid", "quality_score", F.size("errors").alias("n_errors"))
    return J.run_available_now(src, "page-ingest", batch_fn=extract)


def _ttl_sql(checks: str) -> str:
    """Fold of an expiring cache, one check after another: ``checks(domain, ts, seq, outcome, ttl)`` in minutes."""
    return f"""
checks AS ({checks}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts, seq) AS rn FROM checks),
fold AS (
  SELECT domain, rn, seq, outcome, ts + to_minutes(ttl) AS expires, false AS cache_hit FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.domain, n.rn, n.seq, n.outcome, CASE WHEN n.ts <= f.expires THEN f.expires ELSE n.ts + to_minutes(n.ttl) END,
         n.ts <= f.expires
  FROM fold f JOIN numbered n ON n.domain = f.domain AND n.rn = f.rn + 1)"""


SQL_CONSENT_TTL = "WITH RECURSIVE " + _ttl_sql("""
  SELECT 'site-' || CAST(user_id % 40 AS VARCHAR) || '.example.org' AS domain, ts, event_id AS seq,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'dialog_failed' WHEN 'view' THEN 'none' ELSE 'ok' END AS outcome,
    CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 10 ELSE 60 END AS ttl
  FROM events""") + " SELECT domain, seq, outcome, cache_hit FROM fold"


@register("stream_consent_ttl", oracle=SQL_CONSENT_TTL)
def stream_consent_ttl(spark, sf_dir):
    """Domain-level consent-check reuse with outcome-dependent expiry, run as
    a stream that folds pieces of each domain and carries the expiry on."""
    src = J.stream_source(spark, sf_dir, "events", EVENTS_SCHEMA)
    out = J.run_available_now(J.consent_ttl_stream(J.consent_checks_from(src)), "consent-ttl")
    return out.select("domain", "seq", "outcome", "cache_hit")


@register("consent_ttl_reuse", oracle=SQL_CONSENT_TTL)
def consent_ttl_reuse(spark, sf_dir):
    """Batch form of the domain cache: checks served from cache."""
    c = J.consent_checks_from(read_table(spark, sf_dir, "events"))
    return J.consent_ttl_batch(c).select("domain", "seq", "outcome", "cache_hit")


@register("stream_robots_ttl", oracle="WITH RECURSIVE " + SQL_ROBOTS + "," + _ttl_sql("""
  SELECT domain, fetched_at + to_minutes(k * 30) AS ts, k AS seq, CASE WHEN outcome = 'error' THEN 'error' ELSE 'ok' END AS outcome,
    CASE WHEN outcome = 'error' THEN 60 ELSE 24 * 60 END AS ttl
  FROM fs, unnest(range(96)) AS r(k)""") + """
SELECT domain, count(*) FILTER (WHERE NOT cache_hit) AS fetches, count(*) FILTER (WHERE cache_hit) AS cache_hits
FROM fold GROUP BY domain""")
def stream_robots_ttl(spark, sf_dir):
    """robots cache reuse: 24 h for fetched files, 1 h after a fetch error (the reference
    never honours the 1 h entry; we do).  A stream of requests through keyed state."""
    from pagefold.operators import compliance as C
    from pagefold.streaming import state_cache as SC
    fs = C.robots_fetch_state(S.robots(spark, sf_dir))
    # requests for each domain every 30 minutes over two days
    req = fs.select("domain", "fetched_at", "outcome", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("k"))
    req = req.select("domain", (F.col("fetched_at") + F.make_interval(mins=F.col("k") * 30)).alias("ts"),
                     F.col("k").cast("long").alias("seq"),
                     F.when(F.col("outcome") == "error", "error").otherwise("ok").alias("outcome"))
    folder = J.job_folder(spark, "robots-ttl")
    req.write.parquet(f"{folder}/requests.parquet")
    src = J.stream_source(spark, folder, "requests", "domain string, ts timestamp, seq long, outcome string")
    out = SC.run_expiring_cache(src, {"ok": 24 * 60, "error": 60}, folder)
    return out.groupBy("domain").agg(F.count_if(~F.col("cache_hit")).alias("fetches"),
                                     F.count_if("cache_hit").alias("cache_hits"))


#: Files in which the event log arrives for the two queries below; each holds events of all times.
ARRIVALS = 4
SQL_ARRIVED = SQL_TASK_EVENTS.replace("SELECT 'task-'", f"SELECT event_id % {ARRIVALS} AS arrival, 'task-'", 1)


def _arriving(spark, sf_dir, folder):
    """The event log as a stream of ``ARRIVALS`` files, one an epoch."""
    e = read_table(spark, sf_dir, "events")
    for k in range(ARRIVALS):  # files are taken in the order in which they were written
        e.where(F.col("event_id") % ARRIVALS == k).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return J.stream_source(spark, folder, "events", EVENTS_SCHEMA, 1)


@register("stream_late_events", oracle=f"""
WITH a AS (SELECT event_id, ts, event_id % {ARRIVALS} AS arrival FROM events),
latest AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival) AS ts FROM a GROUP BY arrival)
SELECT a.event_id, CAST(a.arrival AS INTEGER) AS epoch, coalesce(a.ts < l.ts - INTERVAL 10 MINUTE, false) AS late
FROM a LEFT JOIN latest l ON l.arrival = a.arrival - 1""")
def stream_late_events(spark, sf_dir):
    """Every event with the epoch it came in, and whether it went to the late-events table."""
    folder = J.job_folder(spark, "late-events")
    events = _arriving(spark, sf_dir, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    on_time, late = J.split_late(events, "ts", J.WATERMARK, folder)
    return on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))).select("event_id", "epoch", "late")


SQL_JOINED = SQL_STATE.replace(SQL_TASK_EVENTS, f"""
task_events AS (SELECT * FROM ({SQL_ARRIVED.strip()[len("task_events AS ("):-1]}) WHERE arrival <= 1)""") + f""",
later AS (SELECT * REPLACE (event_id AS event_id) FROM ({SQL_ARRIVED.strip()[len("task_events AS ("):-1]}) WHERE arrival > 1 AND type = 'log')"""


@register("stream_resumed_updates", oracle=f"""
WITH {SQL_JOINED}
SELECT task_id, 'snapshot' AS kind, n_logs AS event_id, progress, status FROM state
UNION ALL SELECT task_id, 'update', event_id, {_prog_sql()}, NULL FROM later""")
def stream_resumed_updates(spark, sf_dir):
    """What a reader gets who joins after the second epoch: the state of all tasks as of
    that epoch, then the lines of the epochs after it, none of them twice."""
    folder = J.job_folder(spark, "task-feed")
    J.run_task_feed(J.task_events_from(_arriving(spark, sf_dir, folder)), folder)
    snapshot, epoch = J.task_snapshot(spark, folder, 1)
    updates = J.task_updates(spark, folder, epoch)
    return snapshot.select("task_id", F.lit("snapshot").alias("kind"), F.col("n_logs").alias("event_id"), "progress", "status").unionByName(
        updates.select("task_id", F.lit("update").alias("kind"), "event_id", "progress", F.lit(None).cast("string").alias("status")))
