"""An expiring cache as keyed state: one entry per key, timers in event time.

``ExpiringCache`` holds for a key when its entry expires, and the checks that the
watermark has not passed yet.  Checks are answered in event order once it has, whatever
order they came in; an entry whose time is over leaves the state by a timer.  A key's
rows of one micro-batch are one task's: for caches of many keys (hosts and their robots
files).  A key with a large share of all checks belongs to ``jobs.consent_ttl_stream``,
which splits it.

A check older than the watermark is dropped by Spark before it gets here: put
``jobs.split_late`` in front where it must be kept.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagefold.streaming.jobs import _run_epochs

OUTPUT = "domain string, at long, seq long, outcome string, cache_hit boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ExpiringCache(StatefulProcessor):
    """Answers checks ``(domain, at, seq, outcome, lifetime)``, all times in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "at long")
        self.waiting = handle.getListState("waiting", "at long, seq long, outcome string, lifetime long")

    def handleInputRows(self, key, rows, timerValues):
        new = [r for pdf in rows for r in zip(pdf["at"].tolist(), pdf["seq"].tolist(), pdf["outcome"].tolist(), pdf["lifetime"].tolist())]
        self.waiting.appendList(new)
        yield from self._answer(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._answer(key, timerValues)

    def _answer(self, key, times):
        """Answer what the watermark has passed; the next timer is for what has not, or for the entry."""
        passed = times.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] <= passed]
        rest = waiting[len(ready):]
        until = self.expires.get()[0] if self.expires.exists() else None
        out = []
        for at, seq, outcome, lifetime in ready:
            hit = until is not None and at <= until
            if not hit:
                until = at + lifetime
            out.append((key[0], at, seq, outcome, hit))
        if ready or not rest:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        if until is not None and until <= passed and not rest:
            self.expires.clear()  # no check can find it any more
            until = None
        elif until is not None:
            self.expires.update((until,))
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        then = rest[0][0] if rest else until
        if then is not None:
            self.handle.registerTimer(-(-then // 1000))
        if out:
            yield pd.DataFrame(out, columns=["domain", "at", "seq", "outcome", "cache_hit"])


def run_expiring_cache(checks: DataFrame, lifetime_minutes: dict[str, int], folder: str, delay: str = "0 seconds") -> DataFrame:
    """Run ``checks(domain, ts, seq, outcome)`` through the cache; ``domain, ts, seq, outcome, cache_hit``.

    A check is answered when the watermark (latest ``ts`` less ``delay``) has passed it; those
    after that wait in the state for the next run in the same folder.
    """
    spark = checks.sparkSession
    lifetime = F.create_map(*[F.lit(x) for kv in lifetime_minutes.items() for x in kv])[F.col("outcome")].cast("long") * 60_000_000
    rows = checks.select("domain", "ts", F.unix_micros("ts").alias("at"), "seq", "outcome", lifetime.alias("lifetime")).withWatermark("ts", delay)
    answered = rows.groupBy("domain").transformWithStateInPandas(ExpiringCache(), OUTPUT, "Append", "EventTime")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # the only store with timers; the session's own again afterwards
    try:
        _run_epochs(answered, lambda df, epoch: df.write.mode("overwrite").parquet(os.path.join(folder, "out", f"epoch={epoch}")), folder)
    finally:
        spark.conf.set(_PROVIDER, before)
    table = spark.read.schema(OUTPUT).parquet(os.path.join(folder, "out"))
    return table.select("domain", F.timestamp_micros("at").alias("ts"), "seq", "outcome", "cache_hit")
