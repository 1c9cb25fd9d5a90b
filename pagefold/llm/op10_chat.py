"""Chat formatting with minimum-cost role repair (operator 10).

A legal conversation is ``[system] (user assistant)+``.  Every turn keeps its
role or is relabelled, opens a message or is merged into the one before, and
empty turns may be inserted; dynamic programming over the automaton of legal
turns finds the cheapest way.  Ties go to the turn's own role, then user,
assistant, system, from the first turn on, so the answer is unique.

The rows of one conversation may be a third of the table, so no task is given
a conversation: the table is range-partitioned by (conv_id, turn, role, text)
and stored with its partition numbers.  Within a partition whole conversations
are solved at once.  One that crosses partitions is solved by its pieces: a
piece is summed up by its cost from each entering to each leaving state; these
small matrices, two per partition at most, give every piece the cost of what
follows it, and then the state in which it is entered.

Each input turn gives one row with its fragment of the rendered text.  The
fragments of a conversation, joined in ``position`` order, are its rendering;
they are not joined here, as one conversation may be longer than a row.

Cases: turns are ordered by turn (nulls last), role and text; a null conv_id
is one conversation; a null or unknown role can take any role at cost 1; a null
text is empty; repeated rows are turns like others; template marks inside a text
are taken apart; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import read, save
from pagefold.plans.catalog import register

START, SYSTEM, USER, ASSISTANT, UNKNOWN = range(5)
NAMES = ("", "system", "user", "assistant")
ALIASES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT, "human": USER, "prompter": USER,
           "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
MERGE, INSERT, RELABEL, NAME_UNKNOWN = 1, 2, 3, 1
NEVER = 1 << 40
#: Cost and inserted roles from the state before a turn to the turn's role; equal roles merge.
LINKS = {(START, SYSTEM): (0, ()), (START, USER): (0, ()), (START, ASSISTANT): (INSERT, (USER,)),
         (SYSTEM, SYSTEM): (MERGE, ()), (SYSTEM, USER): (0, ()), (SYSTEM, ASSISTANT): (INSERT, (USER,)),
         (USER, USER): (MERGE, ()), (USER, ASSISTANT): (0, ()),
         (ASSISTANT, USER): (0, ()), (ASSISTANT, ASSISTANT): (MERGE, ())}
#: Cost and inserted roles at the end of a conversation, by state.
ENDS = ((0, ()), (2 * INSERT, (USER, ASSISTANT)), (INSERT, (ASSISTANT,)), (0, ()))
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

Vector = tuple[int, ...]


def code(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), UNKNOWN)


def relabel(own: int, role: int) -> int:
    return 0 if own == role else NAME_UNKNOWN if own == UNKNOWN else RELABEL


@lru_cache(maxsize=100_000)
def step(own: int, after: Vector) -> tuple[Vector, tuple[int, ...]]:
    """For each state before a turn: the least cost from there on, and the role that the turn takes."""
    costs, roles = [], []
    order = [r for r in dict.fromkeys((own, USER, ASSISTANT, SYSTEM)) if r in (USER, ASSISTANT, SYSTEM)]
    for state in range(4):
        ways = [relabel(own, r) + LINKS.get((state, r), (NEVER,))[0] + after[r] for r in order]
        least = min(ways)
        costs.append(min(least, NEVER))
        roles.append(order[ways.index(least)])
    return tuple(costs), tuple(roles)


def backward(turns: list[int], end: Vector) -> tuple[Vector, list[tuple[int, ...]]]:
    """Cost from each state before the first turn, and every turn's choice by state."""
    choice = []
    base = 0
    for own in reversed(turns):
        # Kept small so that equal situations share one entry of `step`.
        low = min(end)
        base += low
        end, roles = step(own, tuple(min(c - low, NEVER) for c in end))
        choice.append(roles)
    choice.reverse()
    return tuple(min(c + base, NEVER) for c in end), choice


def solve(turns: list[int], end: Vector, state: int = START) -> list[int]:
    """The roles that the turns take when entered in ``state``."""
    out = []
    for roles in backward(turns, end)[1]:
        state = roles[state]
        out.append(state)
    return out


END: Vector = tuple(cost for cost, _ in ENDS)


def _message(role: int, text: str) -> str:
    return f"{OPEN}{NAMES[role]}\n{text}"


def render(texts: list[str | None], turns: list[int], roles: list[int], state: int, last: bool) -> Iterator[tuple[str, str]]:
    """``(action, fragment)`` per turn; a message is closed by what follows it."""
    for k, (text, own, role) in enumerate(zip(texts, turns, roles)):
        text = (text or "").replace("<|im_", "<| im_")
        merged = state == role
        if merged:
            out = "\n" + text
        else:
            out = CLOSE if state != START else ""
            for r in LINKS[state, role][1]:
                out += _message(r, "") + CLOSE
            out += _message(role, text)
        if last and k == len(texts) - 1:
            out += CLOSE
            for r in ENDS[role][1]:
                out += _message(r, "") + CLOSE
        action = "+".join(([] if own == role else ["relabel"]) + (["merge"] if merged else []))
        yield action or "keep", out
        state = role


# ---- Spark -----------------------------------------------------------------

ROWS = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("conv_id", pa.int64()), ("turn", pa.int64()),
                  ("role", pa.string()), ("text", pa.string())])
OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("role", pa.string()),
                 ("new_role", pa.string()), ("action", pa.string()), ("rendered", pa.string())])


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the place in it, so that both stay fixed from here on."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()),
             *(b.column(f.name).cast(f.type) for f in list(ROWS)[2:])], schema=ROWS)
        at += n


def _pieces(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, int | None, bool, bool, list]]:
    """``(part, conv_id, first in part, last in part, columns)`` per conversation and partition."""
    key, held, first = None, None, True
    for b in batches:
        data = [b.column(c).to_pylist() for c in ("part", "conv_id", *columns)]
        for row in zip(*data):
            now = row[:2]
            if now != key:
                if key is not None:
                    yield *key, first, now[0] != key[0], held
                    first = now[0] != key[0]
                key, held = now, [[] for _ in columns]
            for own, value in zip(held, row[2:]):
                own.append(value)
    if key is not None:
        yield *key, first, True, held


class Chains:
    """What the pieces at partition borders need to know; at most two per partition."""

    def __init__(self, rows: list):
        #: (part, first) -> (conv_id, matrix by leaving state, number of turns)
        self.pieces = {}
        for r in rows:
            self.pieces[r["part"], r["first"]] = r
        order = sorted(rows, key=lambda r: (r["part"], not r["first"]))
        self.end: dict[tuple[int, bool], Vector] = {}
        self.entry: dict[tuple[int, bool], int] = {}
        self.before: dict[tuple[int, bool], int] = {}
        self.chains: list[list] = []
        for r in order:
            # Pieces that lie one after another and have the same conversation belong together.
            if self.chains and self.chains[-1][-1]["conv_id"] == r["conv_id"] and self.chains[-1][-1]["part"] != r["part"]:
                self.chains[-1].append(r)
            else:
                self.chains.append([r])
        for chain in self.chains:
            after, n = END, 0
            for r in reversed(chain):
                self.end[r["part"], r["first"]] = after
                m = r["matrix"]  # cost from state s to leaving state e at 4 * s + e
                after = tuple(min(min(m[4 * s + e] + after[e] for e in range(1, 4)), NEVER) for s in range(4))
            for r in chain:
                self.before[r["part"], r["first"]] = n
                n += r["n"]
            self.entry[chain[0]["part"], chain[0]["first"]] = START
        self.last = {(c[-1]["part"], c[-1]["first"]) for c in self.chains}

    def enter(self, leaving: dict[tuple[int, bool], list[int]]) -> None:
        """Follows each chain: ``leaving`` has a piece's last state for each entering state."""
        for chain in self.chains:
            state = START
            for r in chain:
                self.entry[r["part"], r["first"]] = state
                if len(chain) > 1:
                    state = leaving[r["part"], r["first"]][state]


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, position, role, new_role, action, rendered`` per row of ``turns(conv_id, turn, role, text)``."""
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    rows = save(turns.select("conv_id", "turn", "role", "text").repartitionByRange(*order)
                .sortWithinPartitions(*order)
                .mapInArrow(_numbered, "part int, pos long, conv_id long, turn long, role string, text string"), "chat-turns")

    def again(*columns: str) -> DataFrame:
        return rows.select("part", "pos", "conv_id", *columns).repartition("part").sortWithinPartitions("part", "pos")

    summary = pa.schema([("part", pa.int32()), ("first", pa.bool_()), ("conv_id", pa.int64()), ("n", pa.int64()),
                         ("matrix", pa.list_(pa.int64()))])

    def sums(batches):
        for part, conv, first, last, (roles,) in _pieces(batches, ("role",)):
            if first or last:
                own = [code(r) for r in roles]
                columns = [backward(own, tuple(0 if s == e else NEVER for s in range(4)))[0] for e in range(1, 4)]
                matrix = [NEVER if e == 0 else columns[e - 1][s] for s in range(4) for e in range(4)]
                yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "conv_id": conv, "n": len(own),
                                                   "matrix": matrix}], summary)

    chains = Chains(again("role").mapInArrow(
        sums, "part int, first boolean, conv_id long, n long, matrix array<long>").collect())

    if any(len(c) > 1 for c in chains.chains):
        ends = {(r["part"], r["first"]): chains.end[r["part"], r["first"]]
                for c in chains.chains if len(c) > 1 for r in c}
        leave = pa.schema([("part", pa.int32()), ("first", pa.bool_()), ("states", pa.list_(pa.int64()))])

        def leaving(batches):
            for part, _, first, last, (roles,) in _pieces(batches, ("role",)):
                end = ends.get((part, first)) if first or last else None
                if end is not None:
                    own = [code(r) for r in roles]
                    yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "states": [
                        solve(own, end, s)[-1] for s in range(4)]}], leave)
        found = again("role").mapInArrow(leaving, "part int, first boolean, states array<long>").collect()
        chains.enter({(r["part"], r["first"]): r["states"] for r in found})

    border = {k: (chains.end[k], chains.entry.get(k, START), chains.before[k], k in chains.last) for k in chains.end}

    def write(batches):
        for part, conv, first, last, (turn, role, text) in _pieces(batches, ("turn", "role", "text")):
            end, state, at, closes = border[part, first] if first or last else (END, START, 0, True)
            own = [code(r) for r in role]
            taken = solve(own, end, state)
            done = list(render(text, own, taken, state, closes))
            for k in range(0, len(own), 4096):
                n = len(own[k:k + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip(
                        ([conv] * n, turn[k:k + n], range(at + k, at + k + n), role[k:k + n],
                         [NAMES[r] for r in taken[k:k + n]], [a for a, _ in done[k:k + n]], [t for _, t in done[k:k + n]]),
                        OUT)], schema=OUT)

    return again("turn", "role", "text").mapInArrow(
        write, "conv_id long, turn long, position long, role string, new_role string, action string, rendered string")


ORACLE = r"""
WITH RECURSIVE
t AS (SELECT conv_id, turn, role, text, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
        CASE lower(trim(role)) WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'human' THEN 2 WHEN 'prompter' THEN 2
          WHEN 'assistant' THEN 3 WHEN 'bot' THEN 3 WHEN 'gpt' THEN 3 WHEN 'model' THEN 3 WHEN 'ai' THEN 3 ELSE 4 END AS own
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
r AS (SELECT *, CASE own WHEN 1 THEN 0 WHEN 4 THEN 1 ELSE 3 END AS to_s,
        CASE own WHEN 2 THEN 0 WHEN 4 THEN 1 ELSE 3 END AS to_u,
        CASE own WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 3 END AS to_a FROM t),
-- least cost from turn i on, by the state before it: none, system, user, assistant
back AS (
  SELECT conv_id, max(i) + 1 AS i, 0 AS c0, 4 AS cs, 2 AS cu, 0 AS ca FROM t GROUP BY conv_id
  UNION ALL
  SELECT r.conv_id, r.i,
    least(to_s + cs, to_u + cu, to_a + 2 + ca), least(to_s + 1 + cs, to_u + cu, to_a + 2 + ca),
    least(to_u + 1 + cu, to_a + ca), least(to_u + cu, to_a + 1 + ca)
  FROM back JOIN r ON r.conv_id = back.conv_id AND r.i = back.i - 1),
ways AS (
  SELECT r.*, s.s,
    CASE WHEN s.s < 2 THEN to_s + s.s + cs ELSE 1000000 END AS ws,
    CASE WHEN s.s = 2 THEN to_u + 1 + cu ELSE to_u + cu END AS wu,
    CASE s.s WHEN 2 THEN to_a + ca WHEN 3 THEN to_a + 1 + ca ELSE to_a + 2 + ca END AS wa
  FROM r JOIN back ON back.conv_id = r.conv_id AND back.i = r.i + 1 CROSS JOIN (VALUES (0), (1), (2), (3)) AS s(s)),
pick AS (
  SELECT conv_id, i, s, CASE
    WHEN own = 1 AND ws = least(ws, wu, wa) THEN 1 WHEN own = 3 AND wa = least(ws, wu, wa) THEN 3
    WHEN wu = least(ws, wu, wa) THEN 2 WHEN wa = least(ws, wu, wa) THEN 3 ELSE 1 END AS taken FROM ways),
fwd AS (
  SELECT conv_id, i, 0 AS s, taken FROM pick WHERE i = 1 AND s = 0
  UNION ALL
  SELECT p.conv_id, p.i, fwd.taken, p.taken FROM fwd JOIN pick p ON p.conv_id = fwd.conv_id AND p.i = fwd.i + 1 AND p.s = fwd.taken)
SELECT t.conv_id, t.turn, t.i - 1 AS position, t.role, (['system', 'user', 'assistant'])[taken] AS new_role,
  CASE WHEN own = taken THEN CASE WHEN s = taken THEN 'merge' ELSE 'keep' END
       ELSE 'relabel' || CASE WHEN s = taken THEN '+merge' ELSE '' END END AS action,
  CASE WHEN s = taken THEN chr(10) ELSE
    CASE WHEN s > 0 THEN '<|im_end|>' || chr(10) ELSE '' END
    || CASE WHEN s < 2 AND taken = 3 THEN '<|im_start|>user' || chr(10) || '<|im_end|>' || chr(10) ELSE '' END
    || '<|im_start|>' || (['system', 'user', 'assistant'])[taken] || chr(10) END
  || replace(coalesce(text, ''), '<|im_', '<| im_')
  || CASE WHEN t.i < n THEN '' ELSE '<|im_end|>' || chr(10)
     || CASE WHEN taken = 1 THEN '<|im_start|>user' || chr(10) || '<|im_end|>' || chr(10) ELSE '' END
     || CASE WHEN taken < 3 THEN '<|im_start|>assistant' || chr(10) || '<|im_end|>' || chr(10) ELSE '' END END AS rendered
FROM t JOIN fwd ON fwd.conv_id = t.conv_id AND fwd.i = t.i"""


@register("op10_chat_formatting", oracle=ORACLE)
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired and rendered turns of every conversation."""
    return repair(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
