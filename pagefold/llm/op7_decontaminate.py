"""Benchmark decontamination with suffix arrays over the training text (operator 7).

Each task turns its documents, shard by shard, into one array of word numbers
and sorts the suffixes that can start a match (all words of the shortest window
known to the benchmark; any other suffix cannot match and is left out).  Every
test suffix is then binary-searched in the shard's array: the range of equal
prefixes gives all verbatim occurrences and their places.  A test suffix that matches
one word further than the one before it belongs to the same match, so runs along one
item and one offset are the longest verbatim matches, each with its item, place and
length; the words they cover are what is hit.  Documents never shuffle and no two
documents are compared.

The benchmark's different rows are cut into chunks of at most ``chunk_items`` items and
about ``CHUNK_BYTES``; one chunk after another is collected, broadcast, searched for and
released, and only documents with a match are kept for the merge.  So what is broadcast
has a fixed size (but for an item that is larger by itself) and the benchmark may have any.

Cases: a null or empty text has no words (no hits, not contaminated); an item
without words has no window; a null item id counts as the item ``""``; repeated
items count once per id; repeated rows and null ids give a row each; extra
columns are ignored; an empty benchmark leaves every document clean.
"""

from __future__ import annotations


from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import read, save, text_column
from pagefold.plans.catalog import register

WINDOW = 13
#: Benchmark items in one broadcast; with texts of some hundred words a few tens of MB.
CHUNK_ITEMS = 20_000
#: Text in one broadcast.
CHUNK_BYTES = 32 << 20
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 20

#: Everything but 0-9, a-z and non-ASCII bytes separates words.
_SPACES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; letters beyond ASCII all count as word characters."""
    return (text or "").encode().lower().translate(_SPACES).split()


class TestSuffixes:
    """The windows of one benchmark chunk, ready to be searched for."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.names = sorted({item_id for item_id, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                found.setdefault(tuple(ids[at:at + size]), []).append((place[item_id], at))
        #: Items and starts in them of each window, one window after another.
        self.count = np.array([len(x) for x in found.values()], "i8")
        self.first = np.cumsum(self.count) - self.count
        self.item, self.at = np.array([x for own in found.values() for x in own] or np.empty((0, 2)), "i8").T
        self.size = np.array([len(w) for w in found], "i4")
        self.least = int(self.size.min()) if found else 0
        low = np.zeros((len(found), window), ">u4")
        for row, w in zip(low, found):
            row[:len(w)] = w
        high = np.where(np.arange(window) < self.size[:, None], low, 0xFFFFFFFF).astype(">u4")
        self.low, self.high = _strings(low), _strings(high)
        #: First words that start some window, by number.
        self.starts = np.zeros(len(self.number) + 1, bool)
        for w in found:
            self.starts[w[0]] = True


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings: compared byte by byte, in number order."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{4 * rows.shape[1]}").ravel() if rows.size else np.empty(0, "S4")


def search(tests: TestSuffixes, shard: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(position, length, test window)`` of every occurrence in a shard of word numbers.

    Documents lie one after another, each followed by a zero.
    """
    none = (np.empty(0, "i8"),) * 3
    text = np.array([*chain.from_iterable((*doc, 0) for doc in shard)], "u4")
    if not len(tests.size) or not len(text):
        return none
    zeros = np.flatnonzero(text == 0)
    here = np.flatnonzero(tests.starts[text])
    run = zeros[np.searchsorted(zeros, here)] - here
    here = here[run >= tests.least]
    if not len(here):
        return none
    padded = np.concatenate([text, np.zeros(tests.window, "u4")]).astype(">u4")
    suffixes = _strings(padded[here[:, None] + np.arange(tests.window)])
    order = np.argsort(suffixes, kind="stable")
    suffixes, here = suffixes[order], here[order]
    low = np.searchsorted(suffixes, tests.low, "left")
    high = np.searchsorted(suffixes, tests.high, "right")
    hit = np.flatnonzero(high > low)
    count = (high - low)[hit]
    at = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    which = np.repeat(hit, count)
    return here[at], tests.size[which].astype("i8"), which


def _longest(tests: TestSuffixes, first: np.ndarray, shard: list[list[int]]) -> tuple[np.ndarray, ...]:
    """``(document, item, start, length)`` of the longest matches in a shard, by document."""
    pos, size, which = search(tests, shard)
    times = tests.count[which]
    known = np.repeat(tests.first[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    pos, size = np.repeat(pos, times), np.repeat(size, times)
    item, offset = tests.item[known], pos - tests.at[known]
    order = np.lexsort((pos, offset, item))
    pos, size, item, offset = pos[order], size[order], item[order], offset[order]
    breaks = np.flatnonzero((item[1:] != item[:-1]) | (offset[1:] != offset[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
    low = np.append(0, breaks)[:len(pos)]
    high = np.append(breaks, len(pos))[:len(low)] - 1
    doc = np.searchsorted(first, pos[low], "right") - 1
    start, length, item = pos[low] - first[doc], pos[high] - pos[low] + size[high], item[low]
    order = np.lexsort((length, start, item, doc))
    return doc[order], item[order], start[order], length[order]


def longest_matches(tests: TestSuffixes, texts: list[str | None]) -> list[tuple[int, list[tuple[str, int, int]]]]:
    """Per text: number of words, longest matches ``(item, start, length)`` in words, by item and start."""
    out: list = []
    get = tests.number.get
    shard: list[list[int]] = []

    def flush():
        sizes = np.array([len(d) + 1 for d in shard], "i8")
        doc, item, start, length = _longest(tests, np.cumsum(sizes) - sizes, shard)
        cut = np.searchsorted(doc, np.arange(len(shard) + 1)).tolist()
        for k, ids in enumerate(shard):
            mine = slice(cut[k], cut[k + 1])
            out.append((len(ids), [(tests.names[i], a, n) for i, a, n in zip(item[mine].tolist(), start[mine].tolist(), length[mine].tolist())]))

    held = 0
    for text in texts:
        ids = [get(w, 0) for w in words(text)]
        if shard and held + len(ids) > SHARD_WORDS:
            flush()
            shard, held = [], 0
        shard.append(ids)
        held += len(ids)
    if shard:
        flush()
    return out


def occurrences(tests: TestSuffixes, texts: list[str | None]) -> list[tuple[int, list[int], list[str]]]:
    """Per text: number of words, hit stretches as a flat list start, end, ..., items."""
    return [(n, *_summary(found)) for n, found in longest_matches(tests, texts)]


def _summary(found: list[tuple[str, int, int]]) -> tuple[list[int], list[str]]:
    return merged([x for _, a, n in found for x in (a, a + n)]), sorted({i for i, _, _ in found})


def _chunks(benchmark: DataFrame, chunk_items: int) -> list[DataFrame]:
    """The different rows of the benchmark in parts of bounded size; always at least one."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-count // chunk_items), -(-size // CHUNK_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


_KIND = "n_words long, spans array<long>, items array<string>, matches array<struct<item:string,start:long,length:long>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())),
                    ("matches", pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))])


def _searched(text: Column, shared) -> Column:
    """The struct of ``contamination`` for one broadcast chunk."""
    def run(texts: list) -> list:
        return [(n, *_summary(found), found) for n, found in longest_matches(shared.value, texts)]
    return text_column(run, _KIND, _ARROW)(text)


def _shared(spark: SparkSession, chunk: DataFrame, window: int):
    return spark.sparkContext.broadcast(TestSuffixes([tuple(r) for r in chunk.collect()], window))


def contamination(text: Column, benchmark: DataFrame, window: int = WINDOW, chunk_items: int = CHUNK_ITEMS) -> Column:
    """Struct column ``n_words, spans, items, matches`` of one text column, all chunks at once.

    ``spans`` are the hit stretches [start, end) in words as a flat list, ``items`` the ids of
    the items that occur, sorted as strings, ``matches`` the longest matches (item, start, length).
    """
    @F.arrow_udf(_KIND)
    def merge(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([(x["n_words"], merged([*x["spans"], *y["spans"]]), sorted({*x["items"], *y["items"]}), [*x["matches"], *y["matches"]])
                         for x, y in zip(a.to_pylist(), b.to_pylist())], type=_ARROW)

    spark = benchmark.sparkSession
    first, *rest = [_searched(text, _shared(spark, c, window)) for c in _chunks(benchmark, chunk_items)]
    for other in rest:
        first = merge(first, other)
    return first


def with_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``__found``, the struct of ``contamination``, one chunk after another."""
    spark = benchmark.sparkSession
    chunks = _chunks(benchmark, chunk_items)
    if len(chunks) == 1:
        return docs.withColumn("__found", _searched(docs["text"], _shared(spark, chunks[0], window)))
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    hits = None
    for chunk in chunks:
        shared = _shared(spark, chunk, window)
        found = docs.select("doc_id", mark.alias("mark"), _searched(docs["text"], shared).alias("f")).where(F.size("f.items") > 0)
        found = save(found, "contamination-hits")  # only documents with a match
        shared.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    # A repeated row has its matches several times.
    hits = hits.groupBy("doc_id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("f.matches"))).alias("matches"))

    @F.arrow_udf(_KIND)
    def whole(n_words: pa.Array, matches: pa.Array) -> pa.Array:
        rows = [[(m["item"], m["start"], m["length"]) for m in own or []] for own in matches.to_pylist()]
        return pa.array([(n, *_summary(own), sorted(own)) for n, own in zip(n_words.to_pylist(), rows)], type=_ARROW)

    none = spark.sparkContext.broadcast(TestSuffixes([], window))
    marked = docs.withColumns({"__mark": mark, "__n": _searched(docs["text"], none)["n_words"]})
    joined = marked.join(hits.withColumnsRenamed({"doc_id": "__id", "matches": "__matches"}),
                         marked["doc_id"].eqNullSafe(F.col("__id")) & (marked["__mark"] == F.col("mark")), "left")
    return joined.select(*[marked[c] for c in docs.columns], whole("__n", "__matches").alias("__found"))


def merged(spans: list[int]) -> list[int]:
    """Flat list of disjoint stretches that cover the same words."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _n_hit(found: Column) -> Column:
    """Words covered: the spans are disjoint, so ends minus starts."""
    return F.aggregate(F.transform(found["spans"], lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                       F.lit(0).cast("long"), lambda acc, x: acc + x)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """Word counts, hits and items per row of ``docs(doc_id, text)``, with the stretches found."""
    found = with_contamination(docs.select("doc_id", "text"), benchmark, chunk_items=chunk_items).select("doc_id", F.col("__found").alias("f"))
    return found.select(
        "doc_id", F.col("f.n_words").alias("n_words"), _n_hit(F.col("f")).alias("n_hit"),
        F.size("f.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("f.items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    marked = with_contamination(docs, benchmark, chunk_items=chunk_items)
    hit = _n_hit(F.col("__found"))
    return marked.where(~is_contaminated(hit, F.col("__found.n_words"))).select(*docs.columns)


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM (SELECT *, least(len(w), 13) AS n FROM bw WHERE len(w) > 0))),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM dw CROSS JOIN (SELECT DISTINCT n FROM bwin) WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.n, d.i, b.item_id FROM dwin d JOIN bwin b ON d.win = b.win AND d.n = b.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


@register("op7_benchmark_decontamination", oracle=ORACLE)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return report(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
