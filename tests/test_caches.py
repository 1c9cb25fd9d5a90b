"""Expiring caches in parallel and as keyed state, late events, jobs that go on after a restart."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagefold.streaming import jobs as J
from pagefold.streaming import state_cache as SC
from pagefold.streaming import ttl_cache as C

TTL = {"ok": 60, "error": 5, "dialog_failed": 10}
CHECKS = "domain string, ts timestamp, seq long, outcome string"
T0 = dt.datetime(2024, 1, 1, 23, 0)


def checks(seed, sizes):
    rng = random.Random(seed)
    return [(d, T0 + dt.timedelta(minutes=rng.randrange(span), seconds=rng.choice([0, 0, 30])), k * 1000 + i, rng.choice([*TTL]))
            for k, (d, n, span) in enumerate(sizes) for i in range(n)]


def brute(rows, start=None):
    hits, expires = {}, dict(start or {})
    for d, ts, seq, outcome in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        hits[seq] = d in expires and ts <= expires[d]
        if not hits[seq]:
            expires[d] = ts + dt.timedelta(minutes=TTL[outcome])
    return hits


def hits_of(df):
    return {r["seq"]: r["cache_hit"] for r in df.collect()}


@pytest.mark.parametrize("rows", [7, 50_000])
def test_unbroken_timeline_is_split(spark, rows):
    """One domain with most checks and no idle gap, ties, a dense domain, a single check."""
    given = checks(1, [("hot", 500, 5000), ("few", 30, 5000), ("one", 1, 9), ("dense", 120, 40)])
    df = spark.createDataFrame(given, CHECKS)
    assert hits_of(J.consent_ttl_batch(df, TTL, rows)) == brute(given)
    assert J.consent_ttl_batch(df.limit(0), TTL, rows).count() == 0


def test_blocks_hold_a_part_each(spark):
    given = checks(2, [("hot", 400, 4000)])
    at = spark.createDataFrame(given, CHECKS).select(F.col("domain").alias("key"), F.unix_micros("ts").alias("at"))
    sizes = [r["count"] for r in C._blocks(at, 20).groupBy("key", "block").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 30 and sum(sizes) == 400


def test_start_of_an_entry(spark):
    given = checks(3, [("a", 60, 900), ("b", 60, 900)])
    start = T0 + dt.timedelta(minutes=200)
    ttl = F.create_map(*[F.lit(x) for kv in TTL.items() for x in kv])[F.col("outcome")]
    got = C.replay(spark.createDataFrame(given, CHECKS), "domain", "ts", "seq", ttl, 60, F.when(F.col("domain") == "a", F.lit(start)), 6)
    assert hits_of(got) == brute(given, {"a": start}) and set(got.columns) == {"domain", "ts", "seq", "outcome", "cache_hit"}


def test_inside_a_block():
    rng = random.Random(4)
    for _ in range(200):
        at = np.array(sorted(rng.randrange(60) for _ in range(rng.randrange(1, 30))))
        until = at + np.array([rng.choice([2, 9, 20]) for _ in at])
        for k, leaves in enumerate(C.leaving(at, until)):
            i = k
            while i < len(at):
                last, i = until[i], int(np.searchsorted(at, until[i], "right"))
            assert leaves == last


def written(spark, rows, folder, parts):
    for part in parts(rows):
        spark.createDataFrame(part, CHECKS).coalesce(1).write.mode("append").parquet(f"{folder}/checks.parquet")
    return J.stream_source(spark, str(folder), "checks", CHECKS, 1)


def test_keyed_state_over_files_and_a_restart(spark, tmp_path):
    """Files whose times overlap, a stop in between, then the rest: as the batch form; expired entries leave the state."""
    given = sorted(checks(5, [("a", 60, 700), ("b", 25, 700), ("c", 2, 60)]), key=lambda r: r[1])
    rng = random.Random(6)

    def parts(rows):  # each file is out of order and reaches back less than the delay
        out = [rows[k:k + 15] for k in range(0, len(rows), 15)]
        for p in out:
            rng.shuffle(p)
        return out
    folder = str(tmp_path / "job")
    src = written(spark, given[:45], tmp_path, parts)
    SC.run_expiring_cache(src, TTL, folder, "30 minutes")
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{folder}/ckpt").count()
    assert waiting > 0  # not passed by the watermark
    src = written(spark, given[45:] + [("z", T0 + dt.timedelta(days=9), 90_000, "ok")], tmp_path, parts)
    got = hits_of(SC.run_expiring_cache(src, TTL, folder, "30 minutes"))
    want = brute(given)
    assert got == want and any(want.values())
    left = spark.read.format("statestore").option("stateVarName", "expires").load(f"{folder}/ckpt")
    assert left.count() == 0, "only z is open, and it waits"


def test_late_and_on_time_are_the_input(spark, tmp_path):
    given = checks(7, [("a", 200, 300)])
    src = written(spark, given, tmp_path, lambda rows: [rows[k::4] for k in range(4)])
    on_time, late = J.split_late(src, "ts", "10 minutes", str(tmp_path / "job"))
    rows = lambda df: [(r["domain"], r["ts"], r["seq"], r["outcome"]) for r in df.collect()]
    assert sorted(rows(on_time) + rows(late)) == sorted(given) and late.count() > 100
    latest = {}
    for r in [*on_time.collect(), *late.collect()]:
        latest[r["epoch"]] = max(latest.get(r["epoch"], r["ts"]), r["ts"])
    for df, side in ((on_time, False), (late, True)):
        for r in df.collect():
            before = [t for e, t in latest.items() if e < r["epoch"]]
            assert side == (bool(before) and r["ts"] < max(before) - dt.timedelta(minutes=10))


def test_feed_goes_on_after_a_stop_between_epochs(spark, tmp_path, monkeypatch):
    """The driver is lost in epoch 2 between lines and state: the reader's snapshot is of epoch 1, and no line is lost or doubled."""
    events = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(4):
        e.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = lambda: J.task_events_from(J.stream_source(spark, str(tmp_path), "events", events, 1))
    folder = str(tmp_path / "feed")
    parts, calls = J.task_parts, []

    def stopping(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("driver lost")
        return parts(df)
    monkeypatch.setattr(J, "task_parts", stopping)
    with pytest.raises(Exception, match="driver lost"):
        J.run_task_feed(stream(), folder)
    state, epoch = J.task_snapshot(spark, folder)
    assert epoch == 1 and J.task_updates(spark, folder, epoch).count() == 0
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    cols = ["task_id", "n_logs", *J.OUTPUT_PATTERNS, "status", "progress", "error"]
    want = J.task_state(J.task_events_from(e.where("event_id % 4 < 2")))
    assert rows(state.select(cols)) == rows(want.select(cols))
    J.run_task_feed(stream(), folder)
    lines = J.log_parse(J.task_events_from(e.where("event_id % 4 >= 2")))
    assert rows(J.task_updates(spark, folder, epoch).select(lines.columns)) == rows(lines)
    full, last = J.task_snapshot(spark, folder)
    assert last == 3 and rows(full.select(cols)) == rows(J.task_state(J.task_events_from(e)).select(cols))


def test_fold_job_in_a_named_folder_goes_on(spark, tmp_path):
    """Two runs over files that arrive in between equal one batch; a second run without new files changes nothing."""
    given = sorted(checks(8, [("a", 80, 2000), ("b", 40, 2000)]), key=lambda r: r[1])
    folder = str(tmp_path / "job")
    cut = lambda rows: [rows]
    J.run_available_now(J.consent_ttl_stream(written(spark, given[:50], tmp_path, cut), TTL), "t", folder=folder)
    got = J.run_available_now(J.consent_ttl_stream(written(spark, given[50:], tmp_path, cut), TTL), "t", folder=folder)
    assert hits_of(got) == brute(given) and got.where("late").count() == 0
    again = J.run_available_now(J.consent_ttl_stream(J.stream_source(spark, str(tmp_path), "checks", CHECKS, 1), TTL), "t", folder=folder)
    assert hits_of(again) == brute(given) and again.count() == len(given)
