"""File sources and sinks: result JSON documents, plan Markdown documents,
latest-per-key upserts (SURVEY 2.1).

All readers are schema-first (no inference) and PERMISSIVE: a bad file or
record never fails the job, it is set aside by ``_corrupt_record``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "runId string, planId string, status string, startTime string, endTime string, "
    "extractedData array<struct<title:string,description:string,sourceUrl:string>>, "
    "metrics struct<duration:bigint,itemsExtracted:bigint,pagesProcessed:bigint,errorsEncountered:bigint,"
    "accuracyScore:double>, errors array<string>, timestamp string, _corrupt_record string"
)


def result_documents(runs: DataFrame) -> DataFrame:
    """One result document per run (the reference's execution result file)."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return runs.select(
        F.col("plan_id").alias("plan"),
        F.col("run_id").alias("runId"), F.col("plan_id").alias("planId"), "status",
        F.date_format("start_time", iso).alias("startTime"), F.date_format("end_time", iso).alias("endTime"),
        F.array().cast("array<struct<title:string,description:string,sourceUrl:string>>").alias("extractedData"),
        F.struct(F.col("duration_ms").alias("duration"), F.col("items_extracted").alias("itemsExtracted"),
                 F.col("pages_processed").cast("bigint").alias("pagesProcessed"),
                 F.col("errors_encountered").alias("errorsEncountered"),
                 F.lit(None).cast("double").alias("accuracyScore")).alias("metrics"),
        F.when(F.col("error_message").isNotNull(), F.array("error_message"))
        .otherwise(F.array().cast("array<string>")).alias("errors"),
        F.date_format("end_time", iso).alias("timestamp"))


#: Folders that plans are dealt to, and documents in one file: neither follows the number
#: of plans, and a file stays small enough to be read whole.
PLAN_GROUPS = 64
FILE_DOCUMENTS = 10_000


def sink_results_json(docs: DataFrame, path: str) -> None:
    """``sink_results_json``: JSON documents partitioned by plan, one per line.

    A plan lies in one folder, ``plan_group=<hash of the plan>``, and stays in its
    documents as ``plan``: a folder of its own for every plan would make as many
    files as there are plans.  Rows are gathered by folder first; a rebalance splits
    a large one, and ``FILE_DOCUMENTS`` bounds a file."""
    group = F.pmod(F.xxhash64("plan"), F.lit(PLAN_GROUPS)).cast("int")
    (docs.withColumn("plan_group", group).hint("rebalance", "plan_group").write.mode("overwrite")
     .option("maxRecordsPerFile", FILE_DOCUMENTS).partitionBy("plan_group").json(path))


def src_result_json(spark: SparkSession, path: str) -> DataFrame:
    """``src_result_json``: read every result file, skip bad records, fill
    defaults (id <- file stem, plan/status <- 'unknown', items <- metric or
    item count or 0).

    A file is read whole and holds one document, indented over many lines or
    not, or several, each starting with ``{`` at the start of a line."""
    raw = (spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
           .select("value", F.col("_metadata.file_name").alias("file_name")))
    one = raw.select("file_name", F.explode(F.split("value", r"\n(?=\{)")).alias("doc")).filter(F.trim("doc") != "")
    parsed = one.select("file_name", F.from_json("doc", RESULT_SCHEMA, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("file_name", "r.*")
    ok = parsed.filter(F.col("_corrupt_record").isNull())

    def falsy_or(c, default):
        return F.when(c.isNull() | (c == 0), default).otherwise(c)
    stem = F.regexp_replace("file_name", r"\.(json|txt)$", "")
    return ok.select(
        F.coalesce(F.nullif("runId", F.lit("")), stem).alias("id"), "file_name",
        F.coalesce(F.nullif("planId", F.lit("")), F.lit("unknown")).alias("planId"),
        F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status"),
        falsy_or(F.col("metrics.itemsExtracted"), falsy_or(F.size("extractedData"), F.lit(0))).alias("itemsExtracted"),
        falsy_or(F.col("metrics.pagesProcessed"), F.lit(0)).alias("pagesProcessed"),
        falsy_or(F.col("metrics.duration"), F.lit(0)).alias("duration"),
        F.coalesce(F.nullif("timestamp", F.lit("")), F.nullif("startTime", F.lit("")), F.lit("")).alias("timestamp"))


def plan_markdown(plans: DataFrame) -> DataFrame:
    """Render plan documents (Markdown with an embedded JSON block)."""
    js = F.to_json(F.struct("plan_id", "url", "domain", "confidence"))
    md = F.concat(
        F.lit("# Scraping Plan\n\n**Plan ID:** `"), F.col("plan_id"), F.lit("`\n**Target URL:** ["), F.col("url"),
        F.lit("]("), F.col("url"), F.lit(")\n**Domain:** "), F.col("domain"),
        F.lit("\n**Confidence:** "), F.format_number(F.col("confidence") * 100, 1), F.lit("%\n**Generated:** "),
        F.col("generated"), F.lit("\n\n```json\n"), js, F.lit("\n```\n"))
    return plans.select(F.col("plan_id").alias("plan_key"), md.alias("value"))


def sink_plan_markdown(docs: DataFrame, path: str) -> None:
    """One Markdown file per plan (one record per plan partition)."""
    docs.repartition("plan_key").write.mode("overwrite").partitionBy("plan_key").text(path)


PLAN_ID_RE = r"(?i)\*?\*?Plan ID:\*?\*?\s*`?([^`\n]+)`?"
PLAN_URL_RE = r"(?i)\*?\*?Target URL:\*?\*?\s*\[([^\]]+)\]"
PLAN_DOMAIN_RE = r"(?i)\*?\*?Domain:\*?\*?\s*(\S+)"
PLAN_CONF_RE = r"(?i)\*?\*?Confidence:\*?\*?\s*([\d.]+)%?"
PLAN_GEN_RE = r"(?i)\*?\*?Generated:\*?\*?\s*(\S+)"
JSON_BLOCK_RE = r"(?s)```json\s*(.*?)```"


def src_plan_markdown(spark: SparkSession, path: str, tracking: DataFrame | None = None) -> DataFrame:
    """``src_plan_markdown``: one row per Markdown file: plan id (file stem
    when absent), URL, domain, confidence (percent > 1 -> /100), time, the
    embedded JSON block (NULL when broken) and a tracking-sidecar flag."""
    raw = (spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
           .select("value", F.col("_metadata.file_path").alias("file_path")))

    def rx(p):
        return F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    conf = rx(PLAN_CONF_RE).try_cast("double")
    stem = F.regexp_extract("file_path", r"plan_key=([^/]+)/", 1)
    out = raw.select(
        F.coalesce(F.trim(rx(PLAN_ID_RE)), stem).alias("id"), stem.alias("stem"),
        F.coalesce(rx(PLAN_DOMAIN_RE), F.lit("unknown")).alias("domain"),
        F.coalesce(rx(PLAN_URL_RE), F.lit("")).alias("url"),
        F.coalesce(F.when(conf > 1, conf / 100).otherwise(conf), F.lit(0.0)).alias("confidence"),
        F.coalesce(rx(PLAN_GEN_RE), F.lit("")).alias("createdAt"),
        F.try_parse_json(F.regexp_extract("value", JSON_BLOCK_RE, 1)).alias("plan_json"))
    if tracking is not None:
        t = tracking.select(F.col("stem").alias("_s")).distinct()
        out = out.join(t, out["stem"] == t["_s"], "left").withColumn("hasTrackingData", F.col("_s").isNotNull()) \
            .drop("_s")
    return out


def upsert_latest(records: DataFrame, key: str, ts: str) -> DataFrame:
    """``upsert_latest``: keyed overwrite = the newest record per key
    (``max_by`` combines map-side; no per-key sort)."""
    others = [c for c in records.columns if c != key]
    agg = records.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(ts, *[c for c in others if c != ts]))
                                   .alias("r"))
    return agg.select(key, "r.*")
