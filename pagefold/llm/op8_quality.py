"""Quality rules as a short-circuit cascade (operator 8), built-in functions only.

``measures`` computes the base counts of every whole text inside one row: no
shuffle, no Python.  ``cascade`` then decides.  Its rules differ in cost (some
only compare counts, some read the text again) and in how many documents they
reject, so ``plan_cascade`` measures both on a bounded sample -- the time each
rule takes on its rows, each repeated so that the rule and not the job is timed,
less the time of a rule that does nothing; and the share of rows that it rejects,
smoothed so that rules without a hit still differ by cost -- and orders them by
rejection per cost.  A ``CASE`` evaluates them in that order and stops at the
first that rejects.  The verdict does not depend on the order.

Repeated three-word windows are compared by their 64-bit XXH64 over the three
words, inside one text only.

Cases: a null text counts as empty: no words, ``base_failed``, not kept; null
ids and repeated rows give one row per input row; extra columns are ignored;
an empty table gives an empty result (and the rules keep their listed order).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import read, save
from pagefold.plans.catalog import register

#: Rows of the sample on which cost and selectivity are measured (expected number).
SAMPLE = 2_000
#: Times each rule is run on the sample; the fastest counts.
RUNS = 2
#: Times a sample row is judged in a run.
REPEATS = 8
#: Least cost of a rule, as a share of the time that the rows take without one.
LEAST_COST = 0.02

BLANK = r"[\x20\x09-\x0D]+"
WORDY = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long),
    and ``words, lines`` (the lines that hold a word) for further rules."""
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumns({
        "words": F.filter(F.split("text", BLANK), lambda w: w != ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORDY)),
        "n_symbols": F.char_length("text") - F.char_length(F.regexp_replace("text", SYMBOLS, "")),
    })
    w = F.col("words")
    d = d.withColumn("__h", F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(
            F.array().cast("array<bigint>")))
    # Sorting is left out where no window occurs twice.
    numbered = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(numbered))
                     .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("__s")
    again = F.filter(s, lambda x, k: F.when(k > 0, s[k - 1]["h"] == x["h"]).otherwise(False)
                     | F.when(k < F.size(s) - 1, s[k + 1]["h"] == x["h"]).otherwise(False))
    d = d.withColumn("__p", F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.lit(3), p[k + 1] - x))
                                      .otherwise(F.lit(3))), F.lit(0), lambda a, x: a + x)
    d = d.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.char_length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.col("n_symbols").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }).drop("__h", "__s", "__p")
    # A generator of one row: no later filter is pushed below it, where it would
    # be evaluated on the expressions above, written out again inside their lambdas.
    return d.select(F.inline(F.array(F.struct(*d.columns))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def rules() -> list[Rule]:
    """Rules beyond the base one, in the order used without a sample."""
    n = F.col("n_words")
    lines = F.size("lines")

    def share(of: str, pattern: str) -> Column:
        return F.size(F.filter(of, lambda x: x.rlike(pattern)))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("same_lines", 2 * F.col("n_dup_lines") > lines),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("no_letters", 2 * share("words", r"\p{L}") < n),
        Rule("capitals", 2 * share("words", r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$") > n),
        Rule("bullets", 10 * share("lines", r"^[\x20\t]*[-•*]") > 9 * lines),
        Rule("ellipses", 10 * share("lines", r"(\.\.\.|…)[\x20\t\r]*$") > 3 * lines),
    ]


def plan_cascade(measured: DataFrame, candidates: list[Rule], runs: int = RUNS, repeats: int = REPEATS) -> list[Rule]:
    """``candidates`` by rejection per second, measured on ``measured`` (a bounded, stored sample)."""
    again = measured.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("__again"))

    def run(rejects: Column) -> tuple[float, int, int]:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            rows, hits = again.agg(F.count("*"), F.count_if(rejects)).first()
            took.append(time.perf_counter() - began)
        return min(took), rows // repeats, hits // repeats
    empty, *_ = run(F.col("n_words") < 0)
    order = []
    for at, rule in enumerate(candidates):
        took, rows, hits = run(rule.rejects)
        cost = max(took - empty, LEAST_COST * empty)
        order.append((-(hits + 1) / (rows + 2) / cost, at, rule))
    return [rule for *_, rule in sorted(order, key=lambda x: x[:2])]


def cascade(ordered: list[Rule]) -> Column:
    """True where no rule rejects; stops at the first that does."""
    kept = F.when(base_failed(), False)
    for rule in ordered:
        kept = kept.when(rule.rejects, False)
    return kept.otherwise(True)


def judge(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Measures and verdict per row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", "text")
    share = min(1.0, sample / max(1, docs.select("doc_id").count()))
    stored = save(measures(docs.sample(share, seed=8)).where(~base_failed()), "quality-sample")
    ordered = plan_cascade(stored, rules())
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), cascade(ordered).alias("kept"))


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT r, i, [words[i], words[i + 1], words[i + 2]] AS w
        FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM t WHERE len(words) >= 3)),
twice AS (SELECT r, w FROM win GROUP BY r, w HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (
          SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (r, w)) GROUP BY r),
m AS (
  SELECT doc_id, words, lines, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM t LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > len(lines)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < n_words
    OR 2 * len(list_filter(words, lambda x: regexp_matches(x, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$'))) > n_words
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\t]*[-•*]'))) > 9 * len(lines)
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$'))) > 3 * len(lines)) AS kept
FROM b"""


@register("op8_quality_rules", oracle=ORACLE)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every whole document."""
    return judge(read(spark, sf_dir, "documents", "doc_id", "text"))
