"""Best-fit packing of token sequences (operator 6).

Large-item matching over *lengths*.  Every piece length lies in 1..capacity,
so the corpus' length histogram has at most ``capacity`` rows whatever the
corpus holds; that bounded table is all the driver sees.

1. Tokenize (map only); documents longer than the capacity are cut.  One row
   per piece: ids stay out, their CRC and length go on.
2. ``plan`` works on runs of equal lengths.  Lengths above a third of the
   capacity are matched greedily, the longest first with the longest partner
   that still fits, two at most in a bin.  Smaller lengths then go, longest
   first, to the smallest gap that holds them.  Each step uses up a run of
   items or a run of gaps, so the plan has a few rows per length.
3. A piece's rank among the pieces of its length finds its row in the plan.
   Ranks come from counts per (length, bucket) plus a rank inside the bucket:
   no task sorts all pieces of a common length.

Cases: a null text is an empty document, whose one piece holds the end id
only; null ids and repeated rows are packed like any other row; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefold.llm.common import held, read, save
from pagefold.plans.catalog import register

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Entries that each of a worker's two tables keeps; what comes later is worked out each time.
TABLE_SIZE = 150_000
#: Text whose distinct runs are looked up together; a longer text is one slice.
SLICE_BYTES = 1 << 23
#: Blank-free runs whose ids are put together at once.
BLOCK_RUNS = 1 << 18
#: Buckets that split the pieces of one length when they are ranked.
BUCKETS = 4096

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64())])


class _Table(dict):
    """A look-up table that works out a missing value and keeps it while there is room."""

    def __init__(self, work, room: int):
        super().__init__()
        self.work, self.room = work, room

    def __missing__(self, key):
        value = self.work(key)
        if len(self) < self.room:
            self[key] = value
        return value


class WordEncoder:
    """Token ids as little-endian 32-bit words.

    The vocabulary lower-cases, drops white space and merges inside one
    pre-token only.  Ids are therefore joined from two bounded tables: blank-free
    run -> ids, and pre-token -> ids, which asks the library.  That holds for
    ASCII and the Latin-1 letters; texts with any other character go to the
    library as a whole.  The runs of many texts are split and numbered by Arrow,
    so a table is asked once per distinct run of a slice.
    """

    #: The vocabulary's own pre-token rule, for the characters of the tables.
    RULE = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+"
    OTHER = "[^\t\n\r\x20-~À-ÖØ-öø-ÿ]"

    def __init__(self, path: str, room: int = TABLE_SIZE):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        model, split = self.lib.model, re.compile(self.RULE).findall

        def ids(piece: str) -> bytes:
            if piece.isascii():  # the byte alphabet of the model is ASCII itself here
                return b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(piece)])
            return self.whole(piece)

        pieces = _Table(ids, room)

        def parts(run: str) -> bytes:
            low = run.lower()
            return pieces[low] if run.isalpha() else b"".join(map(pieces.__getitem__, split(low)))

        self.runs = _Table(parts, room)

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order; a null text has none."""
        texts = pc.fill_null(texts, "")
        other = pc.match_substring_regex(texts, self.OTHER)
        for content in self.added:
            other = pc.or_(other, pc.match_substring(texts, content))
        split = pc.ascii_split_whitespace(pc.if_else(other, "", texts))
        coded = split.flatten().dictionary_encode()
        found = [self.runs[run] for run in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), "i8", len(found)) // 4
        first, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
        codes = coded.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(split).to_numpy()).tolist()
        for k, whole, low, high in zip(range(len(texts)), other.to_pylist(), [0, *ends], ends):
            if whole:
                yield self.whole(texts[k].as_py())
                continue
            parts = []
            for at in range(low, high, BLOCK_RUNS):
                runs = codes[at:min(at + BLOCK_RUNS, high)]
                n = sizes[runs]
                parts.append(flat[np.repeat(first[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
            yield b"".join(parts)


def encoder(path: str) -> WordEncoder:
    """One per worker process, kept from task to task."""
    return held(("encoder", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: one row per piece of a document."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        for batch in batches:
            text = batch.column("text")
            size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype="i8")
            edges = [0, *(np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                rows = []
                for doc_id, ids in zip(batch.column("doc_id")[low:high].to_pylist(), encoder(path).encode_all(text[low:high])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Runs:
    """Runs of equal things by size: find the largest size up to a bound, or the smallest from one."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, size: int, first: int, count: int) -> None:
        if count:
            if not self.runs[size]:
                bisect.insort(self.sizes, size)
            self.runs[size].append((first, count))

    def take(self, size: int, most: int) -> tuple[int, int]:
        """Up to ``most`` of that size, from its last run: (first, count)."""
        first, count = self.runs[size].pop()
        if count > most:
            self.runs[size].append((first + most, count - most))
            count = most
        if not self.runs[size]:
            self.sizes.remove(size)
        return first, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first rank, count, first bin, offset)`` from counts per length."""
    rows = []
    gaps = _Runs()
    bins = 0
    large = _Runs()
    for length, count in histogram.items():
        if 3 * length > capacity:
            large.add(length, 0, count)
    while large.sizes:
        a = large.sizes[-1]
        first, count = large.take(a, 1 << 62)
        while count:
            at = bisect.bisect_right(large.sizes, capacity - a) - 1
            if 2 * a <= capacity and (at < 0 or large.sizes[at] < a):
                # What is left of this length pairs with itself.
                pairs, b = count // 2, a
                got = pairs
                second = first + pairs
                if not pairs:
                    at, got = -1, 0
            elif at >= 0:
                b = large.sizes[at]
                second, got = large.take(b, count)
            if at < 0 and not (2 * a <= capacity and count >= 2):
                rows.append((a, first, count, bins, 0))
                gaps.add(capacity - a, bins, count)
                bins += count
                break
            rows.append((a, first, got, bins, 0))
            rows.append((b, second, got, bins, a))
            gaps.add(capacity - a - b, bins, got)
            bins += got
            if b == a and second == first + got:
                first, count = first + 2 * got, count - 2 * got
            else:
                first, count = first + got, count - got
    for length in sorted((n for n in histogram if 3 * n <= capacity), reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect.bisect_left(gaps.sizes, length)
            if at < len(gaps.sizes):
                gap = gaps.sizes[at]
                first, got = gaps.take(gap, count - rank)
                rows.append((length, rank, got, first, capacity - gap))
                gaps.add(gap - length, first, got)
            else:
                # No gap holds it: open bins, each filled with as many as fit.
                each = capacity // length
                full = (count - rank) // each
                for k in range(each if full else 0):
                    rows.append((length, rank + k * full, full, bins, k * length))
                gaps.add(capacity - each * length, bins, full)
                bins, rank = bins + full, rank + full * each
                left = count - rank
                for k in range(left):
                    rows.append((length, rank + k, 1, bins, k * length))
                if left:
                    gaps.add(capacity - left * length, bins, 1)
                    bins += 1
                break
            rank += got
    return rows


def pack(items: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``sequence_id, offset`` to the rows of ``pieces``; ``items`` is read twice."""
    keyed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most capacity * buckets rows, `buckets` in one length: small whatever the corpus holds.
    counts = save(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    by_length: dict[int, tuple] = {}
    rows = sorted(r for r in plan(histogram, capacity) if r[2])
    for length in histogram:
        own = [r for r in rows if r[0] == length]
        by_length[length] = tuple(np.array([r[k] for r in own], "<i8") for k in (1, 3, 4))
    shared = items.sparkSession.sparkContext.broadcast(by_length)

    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (keyed.withColumn("k", F.row_number().over(inside) - 1)
              .join(counts.select("length", "bucket", "before"), ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("rank")))
    schema = PIECES.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.empty(len(rank), "<i8"), np.empty(len(rank), "<i8")
            for n in np.unique(length):
                here = length == n
                first, bin_, at = shared.value[int(n)]
                k = np.searchsorted(first, rank[here], "right") - 1
                seq[here], off[here] = bin_[k] + rank[here] - first[k], at[k]
            columns = [batch.column(c) for c in PIECES.names] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack ``docs(doc_id, text)``; pieces are written once."""
    return pack(save(pieces(docs, path, capacity), "pack-pieces"), capacity)


@register("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers
    return pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(VOCABULARY))
