"""Lifecycle and operations analytics over execution records.

Per-plan numbers are one grouped aggregation (partial + final); history
top-n uses ``row_number`` per plan, which Catalyst turns into a
window-group-limit so each plan keeps only n rows before the sort completes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_fixed(x: Column, digits: int) -> Column:
    """``toFixed``-style rounding as a number (half up)."""
    m = float(10 ** digits)
    return F.floor(x * m + 0.5) / m


def plan_metrics(runs: DataFrame) -> DataFrame:
    """``plan_metrics``: totals, success %, averages, error rate, last run."""
    c = F.col
    g = runs.groupBy("plan_id").agg(
        F.count("*").alias("total_executions"),
        F.count_if(c("status") == "completed").alias("successful_executions"),
        F.count_if(c("status") == "failed").alias("failed_executions"),
        F.sum("items_extracted").alias("total_items_extracted"),
        F.sum("pages_processed").alias("total_pages_processed"),
        F.sum("duration_ms").alias("total_duration"),
        F.sum("errors_encountered").alias("total_errors"),
        F.max_by(F.struct("run_id", "status"), F.struct("end_time", "run_id")).alias("last"),
    )
    n = c("total_executions")
    return g.select(
        "plan_id", "total_executions", "successful_executions", "failed_executions",
        "total_items_extracted", "total_pages_processed", "total_duration", "total_errors",
        c("last.run_id").alias("last_execution_id"), c("last.status").alias("last_execution_status"),
        round_fixed(c("successful_executions") / n * 100, 2).alias("success_rate"),
        round_fixed(c("total_items_extracted") / n, 2).alias("avg_items_per_execution"),
        round_fixed(c("total_duration") / n, 0).alias("avg_duration"),
        round_fixed(c("total_pages_processed") / n, 2).alias("avg_pages_per_execution"),
        round_fixed(c("total_errors") / n * 100, 2).alias("error_rate"))


def global_metrics(runs: DataFrame) -> DataFrame:
    """``global_metrics``: distinct plans, executions, items (true counts)."""
    return runs.agg(F.countDistinct("plan_id").alias("total_plans"), F.count("*").alias("total_executions"),
                    F.sum("items_extracted").alias("total_items_extracted"))


def plan_history_topn(runs: DataFrame, n: int = 100, status_n: int = 50) -> DataFrame:
    """``plan_history_topn``: newest n summaries per plan; the newest
    ``status_n`` are the run ids kept in the plan status."""
    w = Window.partitionBy("plan_id").orderBy(F.desc("end_time"), F.desc("run_id"))
    r = runs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return r.select("plan_id", "run_id", "status", "items_extracted", "pages_processed", "duration_ms",
                    "errors_encountered", "rank", (F.col("rank") <= status_n).alias("in_status"))


def execution_errors(runs: DataFrame) -> DataFrame:
    """``execution_errors``: typed error rows counted by (type, message)."""
    errs = runs.filter(F.col("error_message").isNotNull()).select(
        F.when(F.col("status") == "failed", "EXECUTION_FAILURE").otherwise("EXECUTION_ERROR").alias("error_type"),
        F.col("error_message").alias("message"))
    return errs.groupBy("error_type", "message").agg(F.count("*").alias("count"))


def confidence_filter(plans: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``confidence_filter``: plans at or above the threshold."""
    return plans.filter(F.col("confidence_score") >= threshold)


def workflow_steps(runs: DataFrame) -> DataFrame:
    """``workflow_steps`` fixture: a workflow is a plan's runs within one day
    (bounded groups); each run is a step, completed when the next starts."""
    wf = F.concat(F.col("plan_id"), F.lit("@"), F.date_format("start_time", "yyyy-MM-dd"))
    w = Window.partitionBy("workflow_id").orderBy("start_time", "run_id")
    s = runs.withColumn("workflow_id", wf).select(
        "workflow_id", F.col("event_type").alias("type"), F.col("run_id").alias("step_id"),
        F.row_number().over(w).alias("ord"),
        F.when(F.col("status") == "failed", "failed").otherwise("completed").alias("status"),
        F.col("start_time").alias("started_at"), F.lead("start_time").over(w).alias("completed_at"))
    return s


def workflow_step_durations(steps: DataFrame) -> DataFrame:
    """``workflow_step_durations``: a failed step stops its workflow (later
    steps are skipped); per step type: runs, failures, skips, mean seconds."""
    w = Window.partitionBy("workflow_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    s = steps.withColumn("_prior_fail", F.coalesce(F.max((F.col("status") == "failed").cast("int")).over(w),
                                                   F.lit(0)))
    s = s.withColumn("eff_status", F.when(F.col("_prior_fail") == 1, "skipped").otherwise(F.col("status")))
    secs = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1000000.0
    return s.groupBy("type").agg(
        F.count_if(F.col("eff_status") != "skipped").alias("executed"),
        F.count_if(F.col("eff_status") == "failed").alias("failed"),
        F.count_if(F.col("eff_status") == "skipped").alias("skipped"),
        F.avg(F.when(F.col("eff_status") == "completed", secs)).alias("avg_seconds"))


def plan_status_latest(runs: DataFrame) -> DataFrame:
    """``plan_status_latest``: current lifecycle state from transitions
    (draft at creation, executing at start, completed/failed at end)."""
    t = runs.select("plan_id", F.explode(F.array(
        F.struct(F.col("start_time").alias("ts"), F.lit(1).alias("k"), F.lit("executing").alias("status"),
                 F.col("run_id").alias("run_id")),
        F.struct(F.col("end_time").alias("ts"), F.lit(2).alias("k"), F.col("status").alias("status"),
                 F.col("run_id").alias("run_id")))).alias("t"))
    g = t.groupBy("plan_id").agg(F.max_by("t.status", F.struct("t.ts", "t.k", "t.run_id")).alias("status"),
                                 F.max("t.ts").alias("updated_at"), F.min("t.ts").alias("created_at"),
                                 F.count("*").alias("transitions"))
    return g


def queue_snapshot(runs: DataFrame, at: Column) -> DataFrame:
    """``queue_snapshot``: active (running at ``at``) and queued (start after ``at``)."""
    return runs.agg(
        F.count_if((F.col("start_time") <= at) & (F.col("end_time") > at)).alias("active_workflows"),
        F.count_if(F.col("start_time") > at).alias("queued_executions"))


def runs_browse(runs: DataFrame, search: str = "", plan: str | None = None, page: int = 1,
                page_size: int = 10) -> DataFrame:
    """``runs_browse``: case-insensitive contains search on run and plan id,
    plan filter, newest first with blanks last, one page."""
    r = runs
    if search:
        s = search.lower()
        r = r.filter(F.lower("run_id").contains(s) | F.lower("plan_id").contains(s))
    if plan:
        r = r.filter(F.col("plan_id").contains(plan))
    # a page of results is the feature: sort + offset/limit (TakeOrderedAndProject)
    return r.orderBy(F.desc_nulls_last("start_time"), F.desc("run_id")).offset((page - 1) * page_size) \
        .limit(page_size)


def summaries(plans: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """``kind, id, label, started_at, status`` of plans (domain and URL as label), runs and tasks."""
    nothing = F.lit(None).cast("string")
    return (plans.select(F.lit("plan").alias("kind"), F.col("plan_id").alias("id"), F.concat_ws(" ", "domain", "url").alias("label"),
                         F.col("created_at").alias("started_at"), nothing.alias("status"))
            .unionByName(runs.select(F.lit("run").alias("kind"), F.col("run_id").alias("id"), F.concat_ws(" ", "run_id", "plan_id").alias("label"),
                                     F.col("start_time").alias("started_at"), "status"))
            .unionByName(tasks.select(F.lit("task").alias("kind"), F.col("task_id").alias("id"), F.col("task_id").alias("label"), "started_at", "status")))


def summaries_browse(rows: DataFrame, kind: str, search: str = "", page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of one kind of ``summaries``: contains-search in any case, newest first with blanks last."""
    found = rows.filter((F.col("kind") == kind) & F.lower("label").contains(search.lower()))
    return found.orderBy(F.desc_nulls_last("started_at"), F.desc("id")).offset((page - 1) * page_size).limit(page_size)


def dashboard(rows: DataFrame, newest: int = 5) -> DataFrame:
    """``kind, total, active, newest``: counts per kind and its ``newest`` ids.

    The newest come from a rank that is cut per task before it is shuffled, so a
    kind's rows never meet in one task."""
    totals = rows.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("running", "pending")).alias("active"))
    w = Window.partitionBy("kind").orderBy(F.desc_nulls_last("started_at"), F.desc("id"))
    top = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= newest).groupBy("kind").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("newest"))
    return totals.join(top, "kind", "left")
