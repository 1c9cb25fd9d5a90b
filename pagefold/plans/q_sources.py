"""Registered source / sink queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from pagefold.functions import url as U
from pagefold.plans import duck as D
from pagefold.plans.catalog import register
from pagefold.plans.q_ops import SQL_RUNS
from pagefold.session import checkpoint_dir
from pagefold.sources import derived as S
from pagefold.sources import files as FS
from pagefold.sources.tables import pages


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:10]}")


@register("sink_results_json", oracle=f"WITH {SQL_RUNS} SELECT plan_id AS plan, count(*) AS n_docs FROM runs GROUP BY 1")
def sink_results_json(spark, sf_dir):
    """Write one result document per run (partitioned by plan) to the shared
    folder; report documents written per plan partition."""
    path = _scratch(spark, "results")
    FS.sink_results_json(FS.result_documents(S.executions(spark, sf_dir)), path)
    back = spark.read.schema("plan string").json(path)
    return back.groupBy("plan").agg(F.count("*").alias("n_docs"))


@register("src_result_json", oracle=f"""
WITH {SQL_RUNS}
SELECT run_id AS id, plan_id AS planId, status,
       CASE WHEN items_extracted = 0 THEN 0 ELSE items_extracted END AS itemsExtracted,
       pages_processed AS pagesProcessed, CASE WHEN duration_ms = 0 THEN 0 ELSE duration_ms END AS duration
FROM runs""")
def src_result_json(spark, sf_dir):
    """Read result files back with defaults; a broken file is skipped."""
    path = _scratch(spark, "results")
    FS.sink_results_json(FS.result_documents(S.executions(spark, sf_dir)), path)
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.text(os.path.join(path, "broken"))
    r = FS.src_result_json(spark, path)
    return r.select("id", "planId", "status", "itemsExtracted", "pagesProcessed", "duration")


def _plans(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", "url", U.url_host("url").alias("domain"))
    g = p.groupBy("domain").agg(F.min_by("url", "page_id").alias("url"), F.count("*").alias("n"))
    return g.select(F.concat(F.lit("plan-"), F.col("domain")).alias("plan_id"), "url", "domain",
                    (((F.col("n") % 10) * 10 + 5) / 100.0).alias("confidence"),
                    F.lit("2024-01-01T00:00:00.000Z").alias("generated"), "n")


@register("src_plan_markdown", oracle=f"""
SELECT 'plan-' || domain AS id, domain, url, round((n % 10 * 10 + 5) / 100.0, 6) AS confidence,
       n % 2 = 0 AS hasTrackingData, true AS has_json
FROM (SELECT {D.host('url')} AS domain, arg_min(url, page_id) AS url, count(*) AS n FROM pages GROUP BY 1)""")
def src_plan_markdown(spark, sf_dir):
    """Plan documents are written as Markdown files (one per plan) and read
    back: id, domain, URL, confidence (percent -> fraction), JSON block and
    tracking-sidecar flag (sidecars exist for plans of hosts with an even
    page count)."""
    plans = _plans(spark, sf_dir)
    path = _scratch(spark, "plans")
    FS.sink_plan_markdown(FS.plan_markdown(plans), path)
    tracking = plans.filter(F.col("n") % 2 == 0).select(F.col("plan_id").alias("stem"))
    r = FS.src_plan_markdown(spark, path, tracking)
    return r.select("id", "domain", "url", F.round("confidence", 6).alias("confidence"), "hasTrackingData",
                    F.col("plan_json").isNotNull().alias("has_json"))


@register("upsert_latest", oracle=f"""
WITH {SQL_RUNS}
SELECT plan_id, arg_max(status, (end_time, run_id)) AS status, arg_max(run_id, (end_time, run_id)) AS run_id,
       max(end_time) AS end_time
FROM runs GROUP BY plan_id""")
def upsert_latest(spark, sf_dir):
    """Keyed overwrite of plan status records: the newest record per plan."""
    r = S.executions(spark, sf_dir).select("plan_id", "status", "run_id", "end_time")
    out = FS.upsert_latest(r, "plan_id", "end_time")
    return out.select("plan_id", "status", "run_id", F.col("end_time").cast("timestamp_ntz").alias("end_time"))
