"""Toxicity from a lexicon trie met by Levenshtein automata (operator 1).

* ``Matcher`` walks a word through the product of the lexicon's trie and the
  Levenshtein automata of its terms.  A state is a set of (trie node, edits
  spent); states and their moves are worked out when first needed, so most
  words die after a few letters.  Terms below five letters must match exactly,
  up to eight letters one edit is allowed, two beyond.
* Every hit is weighed by its context window: a hit inside quotation marks, or
  after a reporting cue without direct address, counts a quarter.
* The lexicon, the weight of each (term, edits) and the four coefficients of
  the score are learned from ``labels``: words whose share among toxic rows is
  reliably higher than among the rest, then a logistic fit.  Only rows whose
  crc32(doc_id) mod 3 is not 1 are used, at most ``SAMPLE`` of them (those with
  the smallest hash), so all that the driver holds is bounded.
* Scoring is one pass without a shuffle; ids, labels, language and source are
  no inputs.

Cases: a null text scores as an empty one; a null id is scored and is not held
out; repeated rows get equal scores; repeated labels of an id count as toxic if
one is; null labels are left out; without any labelled row of both kinds there
is nothing to learn and every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import held, read, save, text_column
from pagefold.plans.catalog import register

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 30_000
#: Terms of the lexicon, at most; a term occurs in this many toxic rows or more.
LEXICON_SIZE = 600
LEAST_ROWS = 3
THRESHOLD = 0.7
#: Runs whose matches one worker keeps; what comes later is matched each time.
TABLE_SIZE = 150_000
#: Automaton states that one worker keeps before it starts anew.
STATES = 200_000
#: Runs before and after a hit that form its context, and what a reported hit counts.
CONTEXT = 6
REPORTED = 0.25

SIGNS = ".,;:!?()[]{}\"'“”„«»‹›‘’"
OPENING, CLOSING = "\"“„«‹‘'", "\"”“»›’'"
CUES = frozenset("said says saying called calls calling wrote writes quote quoted quotes quoting word words term "
                 "dit disait écrit appelé citation mot sagte sagt schrieb nannte zitat wort dijo dice escribió "
                 "llamó cita palabra".split())
ADDRESS = frozenset("you your you're youre u tu toi te vous du dich dir ihr sie tú ti usted eres".split())
#: Digits and signs commonly put for letters.
LOOKALIKES = str.maketrans("0134578@$!€", "oieastbasie")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Matcher:
    """Lexicon terms within their edit distance of a word."""

    def __init__(self, terms: tuple[str, ...], wanted: frozenset | None = None, room: int = TABLE_SIZE):
        self.wanted = wanted
        self.children: list[dict[str, int]] = [{}]
        self.term = [-1]
        self.reach = [0]  # edits that the best term below a node allows
        self.room = room
        for n, term in enumerate(terms):
            node, allowed = 0, self.allowed(len(term))
            self.reach[0] = max(self.reach[0], allowed)
            for ch in term:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.reach.append(0)
                node = nxt
                self.reach[node] = max(self.reach[node], allowed)
            self.term[node] = n
        self.lengths = [self.allowed(len(t)) for t in terms]
        self._restart()
        self.split = re.compile(r"[^\W_]+").findall
        self.longrun = re.compile(r"(.)\1{2,}")
        self.table: dict[str, tuple] = {}

    def _restart(self) -> None:
        start = self._close({0: 0})
        self.states: dict[bytes, int] = {start: 0}
        self.sets: list[bytes] = [start]
        self.moves: list[dict[str, int]] = [{}]

    @staticmethod
    def allowed(length: int) -> int:
        return 0 if length < 5 else 1 if length <= 8 else 2

    def _close(self, nodes: dict[int, int]) -> bytes:
        """Adds the nodes reached by leaving out letters of a term; packed, as there are many states."""
        todo = list(nodes.items())
        while todo:
            node, spent = todo.pop()
            for child in self.children[node].values():
                if spent + 1 <= self.reach[child] and nodes.get(child, 9) > spent + 1:
                    nodes[child] = spent + 1
                    todo.append((child, spent + 1))
        return array("I", sorted(node << 2 | spent for node, spent in nodes.items())).tobytes()

    def _nodes(self, state: int) -> Iterator[tuple[int, int]]:
        for packed in array("I", self.sets[state]):
            yield packed >> 2, packed & 3

    def _move(self, state: int, ch: str) -> int:
        nodes: dict[int, int] = {}
        for node, spent in self._nodes(state):
            if spent + 1 <= self.reach[node] and nodes.get(node, 9) > spent + 1:
                nodes[node] = spent + 1  # a letter too many
            for c, child in self.children[node].items():
                cost = spent + (c != ch)
                if cost <= self.reach[child] and nodes.get(child, 9) > cost:
                    nodes[child] = cost
        if not nodes:
            return -1
        key = self._close(nodes)
        nxt = self.states.get(key)
        if nxt is None:
            nxt = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return nxt

    def match(self, word: str) -> dict[int, int]:
        """Term number -> edits."""
        if len(self.sets) > STATES:
            self._restart()
        state = 0
        for ch in word:
            nxt = self.moves[state].get(ch)
            if nxt is None:
                nxt = self.moves[state][ch] = self._move(state, ch)
            if nxt < 0:
                return {}
            state = nxt
        return {self.term[n]: e for n, e in self._nodes(state) if self.term[n] >= 0 and e <= self.lengths[self.term[n]]}

    def run(self, run: str) -> tuple[tuple[int, int], ...]:
        """Matches of one blank-free run: its words, and the run read through disguises
        (signs inside a word, repeated letters, look-alike digits)."""
        core = run.strip(SIGNS)
        if core.isalpha():
            forms = {core}
        else:
            words = self.split(run)
            forms = {core, "".join(words), *words}
            forms |= {form.translate(LOOKALIKES) for form in forms}
        if self.longrun.search(core):
            forms |= {self.longrun.sub(r"\1", form) for form in forms}
        found: dict[int, int] = {}
        for form in forms:
            for term, edits in self.match(form).items():
                found[term] = min(found.get(term, 9), edits)
        if not found:
            return ()
        least = min(found.values())
        return tuple(sorted((t, e) for t, e in found.items()
                            if e == least and (self.wanted is None or (t, e) in self.wanted)))

    def __call__(self, text: str | None) -> tuple[dict[tuple[int, int], float], int]:
        """``{(term, edits): context score}`` and the number of distinct runs."""
        runs = (text or "").lower().split()
        table, found = self.table, {}
        for at, run in enumerate(runs):
            hit = table.get(run)
            if hit is None:
                hit = self.run(run)
                if len(table) < self.room:
                    table[run] = hit
            if hit:
                score = context(runs, at)
                for key in hit:
                    if score > found.get(key, 0.0):
                        found[key] = score
        return found, len(set(runs))


def context(runs: list[str], at: int) -> float:
    """1 for a hit that speaks for itself, ``REPORTED`` for one that is quoted or reported."""
    before, after = runs[max(0, at - CONTEXT):at], runs[at + 1:at + 1 + CONTEXT]
    opened = runs[at][0] in OPENING
    for run in before:
        opened = (opened or run[0] in OPENING) and not (run[-1] in CLOSING or run.rstrip(".,;:!?")[-1:] in CLOSING)
    closed = any(run.rstrip(".,;:!?")[-1:] in CLOSING or run[-1] in CLOSING for run in (runs[at], *after) if run)
    if closed and (opened or runs[at][0] in OPENING):
        return REPORTED
    near = {run.strip(".,;:!?()\"'") for run in before[-4:]}
    if near & CUES and not ({run.strip(".,;:!?()\"'") for run in (*before, *after)} & ADDRESS):
        return REPORTED
    return 1.0


def matcher(terms: tuple[str, ...], wanted: frozenset | None = None) -> Matcher:
    """One per worker process and lexicon, kept from task to task.

    ``wanted``: only these (term, edits) count, None: all.
    """
    return held(("matcher", terms, wanted), lambda: Matcher(terms, wanted))


@dataclass(frozen=True)
class Model:
    """What scoring needs; at most ``LEXICON_SIZE`` terms."""
    terms: tuple[str, ...]
    weights: dict[tuple[int, int], float]
    coefficients: tuple[float, ...]

    def features(self, found: dict[tuple[int, int], float], n: int) -> tuple[float, ...]:
        best: dict[int, float] = {}
        for (term, edits), score in found.items():
            w = score * self.weights.get((term, edits), 0.0)
            best[term] = max(best.get(term, 0.0), w)
        size = math.log1p(n)
        total = sum(sorted(best.values()))
        return 1.0, total, max(best.values(), default=0.0), size, total / max(1.0, size)

    def score(self, found: dict[tuple[int, int], float], n: int) -> float:
        if not self.coefficients:
            return 0.0
        z = sum(a * b for a, b in zip(self.coefficients, self.features(found, n)))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def _weight(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    """Log odds of a row being toxic, less half their standard error."""
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return odds - 0.5 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(b.tolist())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon_size: int = LEXICON_SIZE) -> Model:
    """Learn the model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # At most `sample` rows of two numbers: a bounded broadcast.
    # Rows that repeat an id count once, so the sample stays as small as its bound.
    sampled = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min("text").alias("text"))
    sampled = save(sampled, "toxic-sample")
    n_toxic, n = sampled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_clean = n - n_toxic
    if not n_toxic or not n_clean:
        return Model((), {}, ())
    words = sampled.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word"))
    counts = (words.where("word <> ''").groupBy("word")
              .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(F.col("t") >= LEAST_ROWS))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    # Reliably more common in toxic rows; rare words that a few rows share by chance stay out.
    reliable = counts.where((odds - error > 0.5) & (F.col("t") > 0.002 * n_toxic))
    terms = tuple(r["word"] for r in reliable.orderBy(F.desc((odds - 0.5 * error) * F.sqrt("t")), "word")
                  .select("word").limit(lexicon_size).collect())

    def each(texts):
        for text in texts:
            found, size = matcher(terms)(text)
            yield size, [t for t, _ in found], [e for _, e in found], list(found.values())
    find = text_column(lambda texts: list(each(texts)), "n int, term array<int>, edits array<int>, score array<double>", pa.struct([
        ("n", pa.int32()), ("term", pa.list_(pa.int32())), ("edits", pa.list_(pa.int32())), ("score", pa.list_(pa.float64()))]))
    seen = [(r["toxic"], dict(zip(zip(r["term"], r["edits"]), r["score"])), r["n"])
            for r in sampled.select("toxic", find("text").alias("f")).select("toxic", "f.*").collect()]
    toxic, clean = Counter(), Counter()
    for label, found, _ in seen:
        (toxic if label else clean).update(found)
    weights = {}
    for t in range(len(terms)):
        weights[t, 0] = exact = max(0.0, _weight(toxic[t, 0], clean[t, 0], n_toxic, n_clean))
        for e in (1, 2):
            # Few rows show a given misspelling: lean on the exact term until five do.
            rows_seen = toxic[t, e] + clean[t, e]
            own = _weight(toxic[t, e], clean[t, e], n_toxic, n_clean) if rows_seen else 0.0
            weights[t, e] = max(0.0, (rows_seen * own + 5 * (0.7 if e == 1 else 0.5) * exact) / (rows_seen + 5))
    model = Model(terms, weights, ())
    x = np.array([model.features(found, size) for _, found, size in seen])
    return Model(terms, weights, _logistic(x, np.array([label for label, _, _ in seen], float)))


def score(text: Column, model: Model) -> Column:
    """Struct column ``score, hits, reported`` of a text column."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def each(texts):
        model = shared.value
        find = matcher(model.terms, frozenset(k for k, w in model.weights.items() if w > 0))
        for text in texts:
            found, size = find(text)
            yield model.score(found, size), len(found), sum(s < 1 for s in found.values())
    return text_column(lambda texts: list(each(texts)), "score double, hits int, reported int", pa.struct([
        ("score", pa.float64()), ("hits", pa.int32()), ("reported", pa.int32())]))(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, hits, reported`` per row of ``docs``."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", score(F.col("text"), model).alias("s"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("s.score").alias("score"),
                         (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"),
                         F.col("s.hits").alias("hits"), F.col("s.reported").alias("reported"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns unchanged."""
    model = fit(docs, labels)
    return docs.withColumn("__s", score(docs["text"], model)).where(F.col("__s.score") < THRESHOLD).select(*docs.columns)


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole document."""
    return score_documents(read(spark, sf_dir, "documents", "doc_id", "text"),
                           read(spark, sf_dir, "labels", "doc_id", "toxic"))
