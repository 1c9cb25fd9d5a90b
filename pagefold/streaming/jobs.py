"""Structured Streaming jobs.

Every job is a function of a streaming DataFrame built from the same
column expressions as its batch twin, so batch and stream give the same
answer (tests compare them with ``trigger(availableNow=True)``).

Event time: ``events.ts`` is TIMESTAMP_NTZ in the files, so it is cast to
TIMESTAMP before ``withWatermark``.  Late-data policy: 10-minute watermark;
``split_late`` keeps what comes later in a table of its own.
A keyed cache with an outcome-dependent expiry (consent) replays each micro-batch
in pieces of a key's timeline and carries one row per key to the next one.  Caches of
many small keys (robots) are keyed state with timers, see ``state_cache``.

A job runs in a folder: a stream that is started again in the same folder goes on
after its last committed epoch.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.session import checkpoint_dir, finished, materialize
from pagefold.streaming import ttl_cache

WATERMARK = "10 minutes"

# Log-line progress words (first match wins) and output patterns.
PROGRESS_RULES = [
    (["Initializing"], 15), (["Analyzing", "analysis"], 30), (["Generating", "generation"], 50),
    (["Testing", "test"], 70), (["Saving", "saved"], 90), (["completed", "success"], 95),
]
OUTPUT_PATTERNS = {
    "planId": r"(?i)Plan ID:\s*(\S+)",
    "planFile": r"(?i)saved to:\s*(.+\.md)",
    "resultFile": r"(?i)Results saved to:\s*(.+\.json)",
    "itemsExtracted": r"(?i)Items extracted:\s*(\d+)",
    "pagesProcessed": r"(?i)Pages processed:\s*(\d+)",
}

# Consent cache lifetimes by outcome (minutes) and robots cache (hours).
CONSENT_TTL_MIN = {"ok": 60, "none": 60, "dialog_failed": 10, "error": 5}


def task_events_from(events: DataFrame) -> DataFrame:
    """``task_events`` (task_id, ts, type, data): process output lines of 20
    tasks derived from the event log; large purchases / errors close a task."""
    et = F.col("event_type")
    line = (F.when(et == "view", F.concat(F.lit("Initializing browser for "), F.col("props")))
            .when(et == "click", F.concat(F.lit("Analyzing page "), F.col("event_id").cast("string")))
            .when(et == "signup", F.concat(F.lit("Plan ID: plan-"), F.col("user_id").cast("string"),
                                           F.lit(" saved to: plans/plan-"), F.col("user_id").cast("string"),
                                           F.lit(".md")))
            .when(et == "purchase", F.concat(F.lit("Items extracted: "), F.floor("value").cast("string")))
            .otherwise(F.concat(F.lit("Results saved to: results/run-"), F.col("event_id").cast("string"),
                                F.lit(".json"))))
    closing = (F.col("value") > 49.5) & et.isin("purchase", "error")
    typ = F.when(closing & (et == "purchase"), "complete").when(closing, "error").otherwise("log")
    data = F.when(closing & (et == "purchase"), F.lit("0")).when(closing, F.lit("1")).otherwise(line)
    return events.select(
        F.concat(F.lit("task-"), (F.col("user_id") % 20).cast("string")).alias("task_id"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id"), typ.alias("type"), data.alias("data"))


def with_parsed(task_events: DataFrame) -> DataFrame:
    """Task events with the progress estimate and output fields of log lines (null on others)."""
    d = F.when(F.col("type") == "log", F.col("data"))
    prog = None
    for words, p in PROGRESS_RULES:
        cond = F.lit(False)
        for w in words:
            cond = cond | d.contains(w)
        prog = F.when(cond, F.lit(p)) if prog is None else prog.when(cond, F.lit(p))
    outs = [F.nullif(F.regexp_extract(d, pat, 1), F.lit("")).alias(k) for k, pat in OUTPUT_PATTERNS.items()]
    return task_events.select("*", prog.alias("progress"), *outs)


def log_parse(task_events: DataFrame) -> DataFrame:
    """``stream_log_parse``: progress estimate (first matching rule) and
    output fields per log line (stateless)."""
    return with_parsed(task_events.filter(F.col("type") == "log")).select(
        "task_id", "ts", "event_id", "data", "progress", *OUTPUT_PATTERNS)


def task_state(task_events: DataFrame) -> DataFrame:
    """``stream_task_state``: fold a task's lines into its state -- last progress
    estimate (10 before any), log count, last value of each output field, and
    status and error from its earliest close.

    One aggregate whose parts are mins and maxes by event time, so arrival order
    does not matter; on a stream it runs in update mode."""
    order = F.struct("ts", "event_id")
    closes = F.col("type").isin("complete", "error")

    def last_non_null(c):
        return F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order))
    st = with_parsed(task_events).groupBy("task_id").agg(
        F.coalesce(last_non_null("progress"), F.lit(10)).alias("progress"),
        F.count_if(F.col("type") == "log").alias("n_logs"),
        *[last_non_null(k).alias(k) for k in OUTPUT_PATTERNS],
        F.min_by(F.when(closes, F.col("data").cast("int")), F.when(closes, order)).alias("exit_code"))
    return st.select(
        "task_id", "n_logs", *OUTPUT_PATTERNS.keys(),
        F.when(F.col("exit_code") == 0, "completed").when(F.col("exit_code").isNotNull(), "failed")
        .otherwise("running").alias("status"),
        F.when(F.col("exit_code") == 0, F.lit(100)).otherwise(F.col("progress")).alias("progress"),
        F.when(F.col("exit_code") != 0, F.concat(F.lit("Process exited with code "), F.col("exit_code").cast("string")))
        .alias("error"))


def terminal(task_events: DataFrame) -> DataFrame:
    """``stream_terminal``: the earliest complete/error event closes a task.

    The state is one row per closed task for as long as the stream runs: a task
    may report again at any time, and only the earliest event counts."""
    c = task_events.filter(F.col("type").isin("complete", "error"))
    return c.groupBy("task_id").agg(F.min_by(F.col("data").cast("int"), F.struct("ts", "event_id")).alias("exit_code"),
                                    F.min("ts").alias("closed_at"))


@dataclass(frozen=True)
class Fold:
    """What a job does with a micro-batch and what it carries to the next one."""
    rows: Callable[[DataFrame, DataFrame], DataFrame]   # (batch, carried before) -> rows to write
    carry: Callable[[DataFrame, DataFrame], DataFrame]  # (carried before, rows written) -> carried on
    schema: str


@dataclass(frozen=True)
class Job:
    """A stream and how ``run_available_now`` writes it: rows upserted by ``key``, or a fold."""
    stream: DataFrame
    key: tuple[str, ...] | None = None
    fold: Fold | None = None


def terminal_stream(task_events: DataFrame) -> Job:
    """Streaming form of ``terminal``: a task's earliest close, upserted when an earlier one arrives."""
    return Job(terminal(task_events), key=("task_id",))


def ops_window(runs: DataFrame) -> DataFrame:
    """``stream_ops_window``: 60-second tumbling windows of run starts.  On a
    stream (update mode) the watermark bounds the windows kept open."""
    if runs.isStreaming:
        runs = runs.withWatermark("start_time", WATERMARK)
    return runs.groupBy(F.window("start_time", "60 seconds").alias("w")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("items_extracted").alias("items")).select(
        F.col("w.start").alias("window_start"), "runs", "failed", "items")


# ---------------------------------------------------- variable-expiry caches


def consent_checks_from(events: DataFrame) -> DataFrame:
    """``consent_checks`` (domain, ts, outcome): domain = site of the user
    (user % 40), outcome by event type."""
    outcome = (F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "dialog_failed")
               .when(F.col("event_type") == "view", "none").otherwise("ok"))
    return events.select(F.concat(F.lit("site-"), (F.col("user_id") % 40).cast("string"), F.lit(".example.org"))
                         .alias("domain"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
                         outcome.alias("outcome"))


def _ttl_col(outcome: F.Column, table: dict) -> F.Column:
    m = F.create_map(*[x for kv in table.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return m[outcome]


def consent_ttl_batch(checks: DataFrame, ttl_minutes: dict | None = None, rows: int = ttl_cache.ROWS) -> DataFrame:
    """``stream_consent_ttl`` (batch form): which checks are served from the
    domain cache.  Checks further apart than the longest TTL cannot interact,
    so each domain's timeline is cut at such gaps and every piece is folded
    independently -- a busy domain becomes many pieces, spread over tasks.
    Checks without a domain are left out."""
    table = ttl_minutes or CONSENT_TTL_MIN
    c = checks.withColumn("ttl", _ttl_col(F.col("outcome"), table))
    return _fold_pieces(c.withColumn("start", F.lit(None).cast("timestamp")), max(table.values()), rows)


def _fold_pieces(c: DataFrame, max_ttl: int, rows: int = ttl_cache.ROWS) -> DataFrame:
    """``cache_hit`` per check; ``start`` is the expiry of the domain's entry before its first check.

    A piece of up to ``rows`` checks is folded by one task; one without an idle gap may be
    longer and is replayed in blocks (``ttl_cache``)."""
    from pyspark.sql import Window
    # Gap detection without a per-domain sort: rows are bucketed by
    # (domain, day); each row's predecessor is found inside its bucket, the
    # first row of a bucket takes the last timestamp of the same domain's
    # nearest earlier bucket (a small per-(domain, day) table).  Buckets are
    # a pure function of the row, so every branch of the plan agrees on them.
    r = c.withColumn("_day", F.floor(F.unix_micros("ts") / F.lit(86_400_000_000)).cast("long"))
    w = Window.partitionBy("domain", "_day").orderBy("ts", "seq")
    r = r.withColumn("_prev", F.lag("ts").over(w))
    per = r.groupBy("domain", "_day").agg(F.max("ts").alias("_last"))
    wd = Window.partitionBy("domain").orderBy("_day")
    per = per.withColumn("_prev_last", F.lag("_last").over(wd)).drop("_last")
    r = r.join(per, ["domain", "_day"])
    prev = F.coalesce(F.col("_prev"), F.col("_prev_last"))
    r = r.withColumn("_gap", F.when((F.unix_micros("ts") - F.unix_micros(prev)) > max_ttl * 60 * 1_000_000, 1)
                     .otherwise(0))
    r = r.withColumn("_local", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gaps = r.groupBy("domain", "_day").agg(F.sum("_gap").alias("_g"))
    gaps = gaps.withColumn("_off", F.coalesce(F.sum("_g").over(wd.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0))).drop("_g")
    c = r.join(gaps, ["domain", "_day"]).withColumn("piece", (F.col("_off") + F.col("_local")).cast("long")) \
        .select("domain", "ts", "seq", "outcome", "ttl", "piece", "start")
    schema = "domain string, ts timestamp, seq long, outcome string, ttl int, piece long, cache_hit boolean"
    c = materialize(c, "cache-pieces")
    long = materialize(c.groupBy("domain", "piece").count().where(F.col("count") > rows).drop("count"), "cache-long-pieces")
    short = c.join(long, ["domain", "piece"], "left_anti").select(c.columns)
    parts = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # pieces are spread over tasks and streamed in time order: no group is
    # ever materialized, a busy domain is split at its idle gaps
    ordered = short.repartition(parts, "domain", "piece").sortWithinPartitions("domain", "piece", "ts", "seq")
    out = ordered.mapInPandas(_fold_sorted, schema)
    if long.isEmpty():
        return out
    rest = c.join(long, ["domain", "piece"], "left_semi").select(c.columns).withColumn("_key", F.concat_ws(":", "piece", "domain"))
    rest = ttl_cache.replay(rest, "_key", "ts", "seq", F.col("ttl"), max_ttl, F.col("start"), rows)
    return out.unionByName(rest.select(out.columns))


def _fold_sorted(batches):
    """Fold sorted (domain, piece, ts) rows; the cache state carries across
    Arrow batches of the same partition."""
    key, expires = None, None
    for pdf in batches:
        hits = []
        for d, pc, ts, ttl, start in zip(pdf["domain"], pdf["piece"], pdf["ts"], pdf["ttl"], pdf["start"]):
            if (d, pc) != key:
                key, expires = (d, pc), None if pd.isna(start) else start
            hit = expires is not None and ts <= expires
            hits.append(hit)
            if not hit:
                expires = ts + pd.to_timedelta(int(ttl), unit="m")
        yield pdf.drop(columns="start").assign(cache_hit=hits)


#: What ``consent_ttl_stream`` carries from one micro-batch to the next: a row per domain.
CONSENT_CARRY = "domain string, expires timestamp, last timestamp"


def consent_ttl_stream(checks: DataFrame, ttl_minutes: dict | None = None, rows: int = ttl_cache.ROWS) -> Job:
    """Streaming form, run by ``run_available_now``: each micro-batch is folded
    like the batch form, so no domain is held in one task, whatever the batch
    holds.  Carried on is when a domain's cached entry expires and its last check.

    The checks of a micro-batch are put in event order.  One that is older than
    what an earlier micro-batch has folded cannot be put in its place any more: it
    is answered from the entry as it stands, changes nothing and is marked ``late``."""
    table = ttl_minutes or CONSENT_TTL_MIN

    def fold(batch: DataFrame, carried: DataFrame) -> DataFrame:
        c = batch.drop("cache_hit", "late").join(carried, "domain", "left").withColumnRenamed("expires", "start")
        late = F.coalesce(F.col("ts") < F.col("last"), F.lit(False))
        hits = _fold_pieces(c.where(~late), max(table.values()), rows).withColumn("late", F.lit(False))
        old = c.where(late).select("*", F.coalesce(F.col("ts") <= F.col("start"), F.lit(False)).alias("cache_hit"),
                                   F.lit(True).alias("late"))
        return hits.select(*batch.columns).union(old.select(*batch.columns))

    def carry(carried: DataFrame, done: DataFrame) -> DataFrame:
        # An executed check is later than the entry before it: the newest expiry is the greatest.
        until = F.when(~F.col("cache_hit") & ~F.col("late"), F.timestamp_micros(F.unix_micros("ts") + F.col("ttl").cast("long") * 60_000_000))
        both = carried.union(done.select("domain", until.alias("expires"), "ts"))
        return both.groupBy("domain").agg(F.max("expires").alias("expires"), F.max("last").alias("last"))
    c = checks.select("domain", "ts", "seq", "outcome", _ttl_col(F.col("outcome"), table).alias("ttl"),
                      F.lit(None).cast("boolean").alias("cache_hit"), F.lit(None).cast("boolean").alias("late"))
    return Job(c, fold=Fold(fold, carry, CONSENT_CARRY))


# ------------------------------------------------------------ run helpers


def _epoch(folder: str, table: str, epoch: int) -> str:
    return os.path.join(folder, table, f"epoch={epoch}")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def job_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a job in the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex[:8]}")


def _run_epochs(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """All that the source holds, an epoch after the other; goes on where a run in ``folder`` ended."""
    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(folder, "ckpt"))
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def run_available_now(job: Job | DataFrame, name: str, mode: str | None = None, batch_fn=None,
                      key: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Run a streaming query to completion (``availableNow``) into a parquet
    table in the shared checkpoint folder and return that table (batch).

    ``batch_fn(df, epoch)`` turns each micro-batch into the rows to write;
    default writes the batch as is.  Each epoch has its own folder, overwritten
    when a batch is run again, so a retry never doubles rows.  A job with a fold
    reads what the epoch before carried on and writes its own, also a folder per
    epoch.  ``key`` (update mode, or the job's): the newest epoch's row per key is
    the result -- an upsert without rewriting the table.

    ``folder``: where checkpoint, carried rows and output lie.  Called again with the
    same folder the job goes on after its last committed epoch; new by default.
    """
    job = job if isinstance(job, Job) else Job(job)
    spark = job.stream.sparkSession
    key = key or (list(job.key) if job.key else None)
    mode = mode or ("update" if key else "append")
    base = folder or job_folder(spark, name)

    def write(df, epoch):
        here = _epoch(base, "out", epoch)
        if job.fold:
            own = df.sparkSession
            held = os.path.join(base, "carry")
            before = own.read.schema(job.fold.schema).parquet(os.path.join(held, str(epoch - 1))) if epoch else own.createDataFrame([], job.fold.schema)
            job.fold.rows(df, before).write.mode("overwrite").parquet(here)
            job.fold.carry(before, own.read.parquet(here)).write.mode("overwrite").parquet(os.path.join(held, str(epoch)))
            return
        done = batch_fn(df, epoch) if batch_fn else df
        done.write.mode("overwrite").parquet(here)
    _run_epochs(job.stream, write, base, mode)
    out = os.path.join(base, "out")
    if not _exists(spark, out):
        return spark.createDataFrame([], job.stream.schema)  # no micro-batch: the source is empty
    table = spark.read.parquet(out)
    if key is None:
        return table.drop("epoch")
    rest = [c for c in table.columns if c not in (*key, "epoch")]
    return table.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*key, "_r.*")


def split_late(stream: DataFrame, time: str, delay: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """``late_events``: rows on time and rows that came too late, as two tables with their ``epoch``.

    The watermark of an epoch is the latest ``time`` of all epochs before it less
    ``delay``, as a watermarked aggregate has it; an aggregate would drop a row older
    than that without a word.  Nothing is lost: both tables together are the input.
    """
    def write(df, epoch):
        own = df.sparkSession
        before = own.read.parquet(_epoch(folder, "latest", epoch - 1)) if epoch else own.createDataFrame([], "latest timestamp")
        mark = before.agg(F.max("latest").alias("latest")).select(  # one row
            (F.col("latest") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
        marked = df.join(F.broadcast(mark)).withColumn("_late", F.coalesce(F.col(time) < F.col("_mark"), F.lit(False)))
        marked = marked.drop("_mark")
        for late, table in ((False, "on_time"), (True, "late_events")):
            marked.where(F.col("_late") == late).drop("_late").write.mode("overwrite").parquet(_epoch(folder, table, epoch))
        before.select("latest").unionByName(df.agg(F.max(time).alias("latest"))).agg(F.max("latest").alias("latest")).write.mode("overwrite").parquet(
            _epoch(folder, "latest", epoch))
    _run_epochs(stream, write, folder)
    spark = stream.sparkSession
    if not _exists(spark, os.path.join(folder, "on_time")):
        empty = spark.createDataFrame([], stream.schema).withColumn("epoch", F.lit(0))
        return empty, empty
    return tuple(spark.read.parquet(os.path.join(folder, t)) for t in ("on_time", "late_events"))


# ------------------------------------------- a snapshot and the updates after it

PARTS = ["progress", *OUTPUT_PATTERNS]


def task_parts(task_events: DataFrame) -> DataFrame:
    """What one epoch's events add to the state of their tasks; parts of several epochs
    can be put together in any order."""
    order = [F.col("ts"), F.col("event_id")]
    closes = F.col("type").isin("complete", "error")
    return with_parsed(task_events).groupBy("task_id").agg(
        F.count_if(F.col("type") == "log").alias("n_logs"),
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("value")))).alias(c) for c in PARTS],
        F.min(F.when(closes, F.struct(*order, F.col("data").cast("int").alias("value")))).alias("close"))


def task_state_of(parts: DataFrame) -> DataFrame:
    """``task_state`` from the parts of any number of epochs."""
    st = parts.groupBy("task_id").agg(F.sum("n_logs").alias("n_logs"), *[F.max(c)["value"].alias(c) for c in PARTS],
                                      F.min("close")["value"].alias("exit_code"))
    return st.select(
        "task_id", "n_logs", *OUTPUT_PATTERNS,
        F.when(F.col("exit_code") == 0, "completed").when(F.col("exit_code").isNotNull(), "failed").otherwise("running").alias("status"),
        F.when(F.col("exit_code") == 0, F.lit(100)).otherwise(F.coalesce("progress", F.lit(10))).alias("progress"),
        F.when(F.col("exit_code") != 0, F.concat(F.lit("Process exited with code "), F.col("exit_code").cast("string"))).alias("error"))


def run_task_feed(task_events: DataFrame, folder: str) -> None:
    """Writes each epoch's parsed lines and its parts of the task states."""
    def write(df, epoch):
        log_parse(df).write.mode("overwrite").parquet(_epoch(folder, "lines", epoch))
        task_parts(df).write.mode("overwrite").parquet(_epoch(folder, "parts", epoch))  # last: an epoch with parts is whole
    _run_epochs(task_events, write, folder)


def last_epoch(spark: SparkSession, folder: str) -> int:
    """The last epoch that a feed has written whole; -1 before the first."""
    n = 0
    while finished(spark, _epoch(folder, "parts", n)):
        n += 1
    return n - 1


def task_snapshot(spark: SparkSession, folder: str, epoch: int | None = None) -> tuple[DataFrame, int]:
    """The state of all tasks as of a whole epoch (the last by default), and that epoch."""
    epoch = last_epoch(spark, folder) if epoch is None else epoch
    if epoch < 0:
        raise ValueError("the feed has no epoch yet")
    return task_state_of(spark.read.parquet(*(_epoch(folder, "parts", n) for n in range(epoch + 1)))), epoch


def task_updates(spark: SparkSession, folder: str, after: int) -> DataFrame:
    """Lines of the whole epochs after ``after``: with the snapshot of that epoch, each line once."""
    last = last_epoch(spark, folder)
    paths = [_epoch(folder, "lines", n) for n in range(after + 1, last + 1)]
    kept = [_epoch(folder, "lines", max(last, 0))]
    return spark.read.parquet(*paths) if paths else spark.read.parquet(*kept).limit(0)


def stream_source(spark: SparkSession, folder: str, table: str, schema: str, max_files: int | None = None) -> DataFrame:
    """File source for one table's parquet files inside ``folder``: one file, or
    a folder of files.  ``max_files`` limits a micro-batch; unlimited by default."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = os.path.join(folder, f"{table}.parquet")
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(files).isDirectory():
        return reader.option("pathGlobFilter", "*.parquet").parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
