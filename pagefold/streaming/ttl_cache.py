"""A keyed cache whose entries expire by outcome, replayed in parallel.

A check is a miss if it is later than the expiry of the last miss before it.  So each
check has one successor, the first check of its key after its own expiry, and the misses
are what can be reached from a key's first check: a walk in a functional graph, not a
fold.

1. Every key's timeline is cut into blocks of about ``rows`` checks, wherever that is:
   no idle gap is needed and a busy key has many blocks.
2. Inside a block successors are array lookups; pointer doubling gives for each possible
   entry the expiry with which the walk leaves the block.  A walk enters a block at its
   first check or less than the longest lifetime later, so only those are *doors*.
3. Doors of all blocks are linked, and doubling over the links marks the doors in use;
   rounds grow with the logarithm of the blocks of a key.
4. Each block is replayed from its door in use; a block without one has hits only.

A block is the most that a task holds: ``rows`` checks, or those of one minute.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.session import materialize

ROWS = 50_000
MINUTE = 60_000_000


def _blocks(checks: DataFrame, rows: int) -> DataFrame:
    """``checks`` with ``block``: the key's checks before this one's minute, in units of ``rows``."""
    minute = F.floor(F.col("at") / MINUTE)
    per = checks.groupBy("key", minute.alias("minute")).agg(F.count("*").alias("n"))
    # At most a row for each minute of the time that the checks span.
    before = F.sum("n").over(Window.partitionBy("key").orderBy("minute")) - F.col("n")
    blocks = materialize(per.select("key", "minute", F.floor(before / rows).alias("block")), "cache-blocks")
    return checks.withColumn("minute", minute).join(blocks, ["key", "minute"]).drop("minute")


def _per_block(checks: DataFrame, extra: list[str], answer, schema: pa.Schema, kind: str) -> DataFrame:
    """``answer(columns)`` of each block's rows in time order, a block at a time."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            out = answer(table)
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type)
                                               for f in schema], schema=schema)
        for batch in batches:
            keys, blocks = batch.column("key").to_pylist(), batch.column("block").to_pylist()
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or blocks[k] != blocks[k - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                now = (keys[a], blocks[a])
                if held and now != last:
                    yield done()
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    cols = ["key", "block", "at", "seq", "until", *extra]
    return checks.select(*cols).repartition("key", "block").sortWithinPartitions("key", "block", "at", "seq").mapInArrow(run, kind)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


def leaving(at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """The expiry with which a walk that enters at each check leaves the block."""
    n = len(at)
    jump = np.append(np.searchsorted(at, until, "right"), n)  # n: outside
    last = np.arange(n + 1)
    while True:
        inside = jump < n
        if not inside.any():
            return until[last[:n]]
        last = np.where(inside, last[np.minimum(jump, n)], last)
        jump = np.where(inside, jump[np.minimum(jump, n)], jump)


def misses(at: np.ndarray, until: np.ndarray, door: int | None) -> np.ndarray:
    """Which checks the walk that enters at time ``door`` meets."""
    out = np.zeros(len(at), bool)
    k = len(at) if door is None else int(np.searchsorted(at, door, "left"))
    after = np.searchsorted(at, until, "right")
    while k < len(at):
        out[k] = True
        k = int(after[k])
    return out


def _doors(checks: DataFrame, longest: int) -> DataFrame:
    """``key, block, at, expires``: the possible entries of each block."""
    schema = pa.schema([("key", checks_type(checks)), ("block", pa.int64()), ("at", pa.int64()), ("expires", pa.int64())])

    def answer(table: pa.Table) -> dict:
        at, until = (_column(table, c).to_numpy() for c in ("at", "until"))
        out = leaving(at, until)
        # The first check later than the longest lifetime is a door too; of equal times the first.
        reach = min(len(at), int(np.searchsorted(at, at[0] + longest, "right")) + 1)
        use = np.flatnonzero(np.append(True, at[1:reach] != at[:reach - 1]))
        return {"key": _column(table, "key").take(pa.array(use)), "block": _column(table, "block").take(pa.array(use)), "at": at[use], "expires": out[use]}
    return _per_block(checks, [], answer, schema, f"key {checks.schema['key'].dataType.simpleString()}, block long, at long, expires long")


def checks_type(checks: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(checks.schema["key"].dataType)


def first_after(doors: DataFrame, times: DataFrame) -> DataFrame:
    """``times`` (``key``, ``t``) with ``to``, the first door later than ``t``; no row where there is none.

    Times and doors meet in (key, hour) parts; beyond its last door an hour has the
    first one of the key's next hour that has any."""
    hour = F.floor(F.col("t") / (60 * MINUTE))
    points = doors.select("key", F.col("at").alias("t"), F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("from_block"),
                          "block", F.col("at").alias("door"))
    asked = times.select("key", "t", "from", "from_block", F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("door"))
    both = points.unionByName(asked).withColumn("hour", hour)
    # At one time a door stands before the times asked for: it is not later.
    inside = Window.partitionBy("key", "hour").orderBy("t", F.col("door").isNull().cast("int")).rowsBetween(1, Window.unboundedFollowing)
    near = both.withColumn("near", F.first(F.when(F.col("door").isNotNull(), F.struct("door", "block")), ignorenulls=True).over(inside))
    hours = both.groupBy("key", "hour").agg(F.min(F.when(F.col("door").isNotNull(), F.struct("door", "block"))).alias("first"))
    later = F.first("first", ignorenulls=True).over(Window.partitionBy("key").orderBy("hour").rowsBetween(1, Window.unboundedFollowing))
    hours = hours.select("key", "hour", later.alias("later"))
    asked = near.where("door IS NULL").join(hours, ["key", "hour"]).withColumn("to", F.coalesce("near", "later"))
    return asked.where("to IS NOT NULL").select("key", "from", "from_block", F.col("to.door").alias("to"), F.col("to.block").alias("to_block"))


def _doors_in_use(doors: DataFrame, started: DataFrame) -> DataFrame:
    """``key, block, door``: doors that the walk of each key passes."""
    entry = first_after(doors, started.select("key", F.col("start").alias("t"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("from_block")))
    used = materialize(entry.select("key", F.col("to").alias("door"), F.col("to_block").alias("block")), "cache-used")
    links = doors.select("key", F.col("expires").alias("t"), F.col("at").alias("from"), F.col("block").alias("from_block"))
    jump = materialize(first_after(doors, links).select("key", "from", "to", "to_block"), "cache-links")
    count = used.count()
    while count:
        ahead = used.join(jump, (used["key"].eqNullSafe(jump["key"])) & (used["door"] == jump["from"])).select(
            used["key"], F.col("to").alias("door"), F.col("to_block").alias("block"))
        more = materialize(used.unionByName(ahead).distinct(), "cache-used")
        grown = more.count()
        if grown == count:
            break
        used, count = more, grown
        a, b = jump.alias("a"), jump.alias("b")
        jump = materialize(a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.to") == F.col("b.from"))).select(
            "a.key", "a.from", "b.to", "b.to_block"), "cache-links")
    return used


def replay(checks: DataFrame, key: str, ts: str, order: str, lifetime: Column, longest_minutes: int, start: Column | None = None, rows: int = ROWS) -> DataFrame:
    """All columns of ``checks`` with ``cache_hit``.

    ``lifetime``: minutes that a miss is kept, at most ``longest_minutes``; ``order``
    decides between checks of one time; ``start``: expiry of the key's entry before its
    first check, the same in all its rows (null: none).
    """
    given = checks.columns
    at = checks.select("*", F.col(key).alias("key"), F.unix_micros(ts).alias("at"), F.col(order).alias("seq_"),
                       (start if start is not None else F.lit(None).cast("timestamp")).alias("start_"))
    at = at.select(F.struct(*given).alias("row"), "key", "at", F.col("seq_").alias("seq"), (F.col("at") + lifetime.cast("long") * MINUTE).alias("until"),
                   F.coalesce(F.unix_micros("start_"), F.lit(-(1 << 62))).alias("start"))
    at = materialize(_blocks(at, rows), "cache-checks")
    doors = materialize(_doors(at, longest_minutes * MINUTE), "cache-doors")
    used = _doors_in_use(doors, at.groupBy("key").agg(F.max("start").alias("start")))
    at = at.join(used, ["key", "block"], "left")
    fields = at.schema["row"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    schema = pa.schema([("row", to_arrow_type(fields)), ("cache_hit", pa.bool_())])

    def answer(table: pa.Table) -> dict:
        at, until = (_column(table, c).to_numpy() for c in ("at", "until"))
        return {"row": _column(table, "row"), "cache_hit": ~misses(at, until, table.column("door")[0].as_py())}
    out = _per_block(at, ["row", "door"], answer, schema, f"row {fields.simpleString()}, cache_hit boolean")
    return out.select("row.*", "cache_hit")
