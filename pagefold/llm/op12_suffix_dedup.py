"""Removal of long repeated byte strings with suffix arrays by two-stage sorting (operator 12).

1. ``cells``: every string of ``length`` bytes picks an anchor, the 64-byte gram in
   it with the smallest hash (the last one of equals).  The choice depends on the
   string alone, so equal strings pick equal anchors at equal places, and a string
   whose anchor stands nowhere else cannot be repeated.  Neighbouring starts with
   the same anchor form a cell: their strings lie in one stretch of the text.
2. Equal stretches meet in one row with their number before anything is sorted, so
   a group of copies costs one stretch.  Only stretches whose anchor is repeated
   get their text, and those of one anchor meet in one shard.
3. ``two_stage``: in a shard, suffixes smaller than their successors are sorted
   directly, the rest is induced from them by one scan over the buckets of first
   bytes; ``common_prefixes`` of neighbours in the array then name the repeated
   strings.  Suffixes that no string of ``length`` bytes needs are left out.
4. An anchor with more than ``group`` different stretches (a passage that a third
   of all documents share, before different continuations) is cut: the places of
   the anchor in the string are halved, and each half is keyed by the longer text
   that all its strings then share.  Halves that are equal meet in one row again.
   A half with one place left is a single string, so cutting ends after
   log2(length) rounds, no shard grows with the corpus and no string is lost.
5. Starts go back to their documents, and the union of their bytes is cut out.

Cases: a null text counts as empty; shorter texts keep every byte; repeated rows and
rows of equal text are documents of their own, so their strings are repeated; null
ids take part and give a row each; extra columns are ignored; an empty table gives an
empty result.  What is kept may cut a character in two and is therefore binary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import SLICE_ROWS, arrow_map, read, save
from pagefold.plans.catalog import register

LENGTH = 400
GRAM = 64
#: Different stretches of one anchor that a shard takes.
GROUP = 512
#: Text of one suffix array; a group of stretches is never cut by it.
SHARD_BYTES = 1 << 20
#: Bytes hashed at once; positions within must fit the low bits of ``_PLACE``.
BLOCK = 1 << 17
_PLACE = np.uint64((1 << 19) - 1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, 2 * BLOCK)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), 2 * BLOCK)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every position on; equal bytes, equal hash."""
    total = np.zeros(len(data) + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * _DOWN[:len(data)], out=total[1:])
    out = (total[gram:] - total[:-gram]) * _UP[:len(data) - gram + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours: prefix and suffix minima of blocks."""
    rows = -(-len(values) // width)
    block = np.full(rows * width, np.iinfo("u8").max, "u8")
    block[:len(values)] = values
    block = block.reshape(rows, width)
    left = np.minimum.accumulate(block, 1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:len(values) - width + 1], left[width - 1:len(values)])


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Bytes of at most two ``BLOCK`` and the pieces ``(text, start in it, start in block, size)``.

    Pieces of a long text overlap by ``length - 1``, so each string lies in one of them."""
    held: list[bytes] = []
    pieces: list[tuple[int, int, int, int]] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, BLOCK - length):
            piece = text[at:at + BLOCK - 1]
            if size + len(piece) > BLOCK and held:
                yield b"".join(held), pieces
                held, pieces, size = [], [], 0
            pieces.append((k, at, size, len(piece)))
            held.append(piece)
            size += len(piece)
    if held:
        yield b"".join(held), pieces


def cell_rows(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, list]:
    """The cells of some texts: ``text`` (its number), ``grp`` (hash of the anchor), ``cid``
    (128-bit hash of stretch and anchor place), ``start``, ``n`` starts, ``place`` of the
    anchor in the stretch."""
    from xxhash import xxh3_128_digest
    width = length - gram + 1
    out: dict[str, list] = {k: [] for k in ("text", "grp", "cid", "start", "n", "place")}
    for block, pieces in _blocks(texts, length):
        hashes = _gram_hashes(np.frombuffer(block, "u1"), gram)
        marked = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype="u8"))
        anchor = (_PLACE - (_sliding_least(marked, width) & _PLACE)).astype("i8")
        for k, at, first, size in pieces:
            own = anchor[first:first + min(size - length + 1, BLOCK - length)]
            low = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            n = np.diff(np.append(low, len(own)))
            place = own[low] - first - low
            out["text"] += [k] * len(low)
            out["grp"].append(hashes[own[low]].view("i8"))
            out["start"].append(low + at)
            out["n"].append(n)
            out["place"].append(place)
            low += first
            out["cid"] += [xxh3_128_digest(block[a:b], p) for a, b, p in
                           zip(low.tolist(), (low + n + length - 1).tolist(), place.tolist())]
    for name in ("grp", "start", "n", "place"):
        out[name] = np.concatenate(out[name]) if out[name] else np.empty(0, "i8")
    return out


def two_stage(codes: np.ndarray, blob: bytes, first: np.ndarray, n: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``length`` bytes.

    ``blob`` holds stretches that start at ``first`` and end at ``last``, a byte apart;
    ``codes`` are its bytes plus one, zero for those between.  Taken are the first ``n``
    positions of each stretch and the few behind them that these are induced from.
    """
    # Smaller than the successor: decided at the end of each run of equal bytes.
    ends = np.append(np.flatnonzero(codes[1:] != codes[:-1]), len(codes) - 1)
    starts = np.append(0, ends[:-1] + 1)
    following = np.append(codes[ends[:-1] + 1], -1)
    smaller = np.repeat((codes[ends] < following) | (codes[ends] == 0), ends - starts + 1)
    before = np.arange(len(codes)) - np.repeat(starts, ends - starts + 1)
    direct = np.flatnonzero(smaller)
    stop = direct[np.searchsorted(direct, first + n - 1)]
    taken = np.zeros(len(codes) + 1, "i1")
    np.add.at(taken, first, 1)
    np.add.at(taken, stop + 1, -1)
    taken = np.cumsum(taken[:-1], dtype="i1").astype(bool)
    direct = direct[taken[direct]]
    none = direct[codes[direct] == 0]
    direct = direct[codes[direct] != 0]
    end = np.minimum(direct + length, last[np.searchsorted(first, direct, "right") - 1])
    keys = [blob[a:b] for a, b in zip(direct.tolist(), end.tolist())]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), "i8")]
    bounds = np.searchsorted(codes[direct], np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for code in np.unique(codes[taken]).tolist():
        larger = np.concatenate(induced[code]) if induced[code] else np.empty(0, "i8")
        if len(larger):
            # Within a run each position induces the one before it: round by round.
            runs = before[larger] + 1
            rounds = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            larger = (np.repeat(larger, runs) - rounds)[np.argsort(rounds, kind="stable")]
        bucket = np.concatenate([larger, none if code == 0 else direct[bounds[code]:bounds[code + 1]]])
        out.append(bucket)
        new = bucket - 1
        new = new[codes[new] > code]
        kinds = codes[new]
        order = np.argsort(kinds, kind="stable")
        new, kinds = new[order], kinds[order]
        cuts = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        for part in np.split(new, cuts) if len(new) else []:
            induced[codes[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, ``length`` at most; ``data`` goes on behind them."""
    words = -(-length // 8)
    row = np.ndarray((len(data) - 8 * words + 1,), f"V{8 * words}", data, strides=(1,))
    out = np.empty(len(a), "i8")
    for at in range(0, len(a), 2048):
        x, y = (row[p[at:at + 2048]].view("<u8").reshape(-1, words) for p in (a, b))
        differ = x != y
        word = differ.argmax(1)
        rows = np.arange(len(word))
        bits = x[rows, word] ^ y[rows, word]
        inside = np.bitwise_count((bits & -bits) - np.uint64(1)).astype("i8") // 8
        out[at:at + 2048] = np.where(differ[rows, word], 8 * word + inside, length)
    return np.minimum(out, length)


def repeated_starts(stretches: list[tuple[bytes, int, bool]], length: int) -> list[tuple[int, int, int]]:
    """``(stretch, from, to)``: the starts in each stretch whose string stands elsewhere too.

    ``stretches`` are ``(bytes, number of starts, several)``; one that stands at several
    places is repeated whole.
    """
    sizes = np.array([len(s) + 1 for s, _, _ in stretches], "i8")
    first = np.cumsum(sizes) - sizes
    n = np.array([k for _, k, _ in stretches], "i8")
    blob = b"\0".join([*(s for s, _, _ in stretches), bytes(length + 8)])
    data = np.frombuffer(blob, "u1")
    codes = data[:sizes.sum()].astype("i2") + 1
    codes[first + sizes - 1] = 0
    array = two_stage(codes, blob, first, n, first + sizes - 1, length)
    mark = np.zeros(len(codes) + 1, "i1")
    np.add.at(mark, first, 1)
    np.add.at(mark, first + n, -1)
    array = array[np.cumsum(mark[:-1], dtype="i1")[array] > 0]
    same = common_prefixes(data, array[:-1], array[1:], length) >= length
    repeated = np.zeros(len(codes) + 1, bool)
    repeated[array[1:][same]] = True
    repeated[array[:-1][same]] = True
    for k in [k for k, (_, _, several) in enumerate(stretches) if several]:
        repeated[first[k]:first[k] + n[k]] = True
    edges = np.flatnonzero(np.diff(repeated.astype("i1"), prepend=0))
    low, high = edges[::2], edges[1::2]
    which = np.searchsorted(first, low, "right") - 1
    return [*zip(which.tolist(), (low - first[which]).tolist(), (high - first[which]).tolist())]


def _identity(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, text``: id and hash of the text name a document's content."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))


def cells(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The cells of every row of ``rows(doc_id, mark, text)``."""
    import pyspark.sql.pandas.types as types
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", types.to_arrow_type(kind)), ("mark", pa.int64()), ("grp", pa.int64()), ("cid", pa.binary()),
                        ("start", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])

    def run(batch: pa.RecordBatch):
        got = cell_rows([t.as_buffer().to_pybytes() for t in batch.column("text")], length, gram)
        which = pa.array(got.pop("text"), pa.int64())
        return {"doc_id": batch.column("doc_id").take(which), "mark": batch.column("mark").take(which), **got}

    long_enough = rows.where(F.octet_length("text") >= length)
    return long_enough.mapInArrow(arrow_map(run, schema), f"doc_id {kind.simpleString()}, mark long, grp long, cid binary, start long, n int, place int")


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


_STRETCH = "grp long, cid binary, weight long, members long, n int, place int, low int, high int, span binary"
_ANSWER = f"from long, to long, {_STRETCH}"
_ANSWER_ARROW = pa.schema([("from", pa.int64()), ("to", pa.int64()), ("grp", pa.int64()), ("cid", pa.binary()), ("weight", pa.int64()),
                           ("members", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32()),
                           ("span", pa.binary())])


def _sized(stretches: DataFrame) -> DataFrame:
    """With ``members``, the different stretches of the anchor; those that stand alone are gone."""
    sizes = stretches.groupBy("grp").agg(F.count("*").alias("members"), F.sum("weight").alias("total")).where("total > 1")
    # Written: a join with a table, unlike one with an aggregate, is split where an anchor is hot.
    return stretches.join(save(sizes.drop("total"), "suffix-sizes"), "grp")


def _with_text(stretches: DataFrame, rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Text of each stretch from the one document that ``stretches(doc_id, mark, start)`` names."""
    wanted = stretches.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(
        "grp", "cid", "weight", "members", "start", "n", "place")).alias("wanted"))
    joined = rows.join(wanted, _same_document(rows, wanted)).select("text", "wanted")
    schema = pa.schema([f for f in _ANSWER_ARROW if f.name not in ("from", "to")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_buffer().to_pybytes()
                w = batch.column("wanted")[k].values
                spans = [text[a:a + n - 1 + length] for a, n in zip(w.field("start").to_pylist(), w.field("n").to_pylist())]
                made = {c: w.field(c) for c in ("grp", "cid", "weight", "members", "n", "place")}
                made |= {"low": np.zeros(len(w), "i4"), "high": np.full(len(w), length - gram, "i4"), "span": spans}
                for at in range(0, len(w), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name][at:at + (1 << 14)], type=f.type) for f in schema], schema=schema)

    return joined.mapInArrow(run, _STRETCH)


def _shards(stretches: DataFrame, length: int, group: int) -> DataFrame:
    """One suffix array after another: ``cid, from, to`` of repeated starts.  Stretches of
    an anchor with too many of them come back as they are, with ``from`` null."""
    def answer(held: dict) -> pa.RecordBatch | None:
        found = repeated_starts([*held.values()], length)
        cids = [*held]
        made = {"cid": [cids[k] for k, _, _ in found], "from": [a for _, a, _ in found], "to": [b for _, _, b in found]}
        return pa.RecordBatch.from_arrays([pa.array(made.get(f.name, [None] * len(found)), type=f.type) for f in _ANSWER_ARROW], schema=_ANSWER_ARROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[bytes, int, bool]] = {}
        size, last = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                large = part.filter(pa.compute.greater(part.column("members"), group))
                if large.num_rows:
                    empty = pa.nulls(large.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([empty if f.name in ("from", "to") else large.column(f.name).cast(f.type)
                                                      for f in _ANSWER_ARROW], schema=_ANSWER_ARROW)
                for grp, cid, weight, members, n, span in zip(*(part.column(c).to_pylist() for c in ("grp", "cid", "weight", "members", "n", "span"))):
                    if members > group:
                        continue
                    if size >= SHARD_BYTES and grp != last:
                        yield answer(held)
                        held, size = {}, 0
                    last = grp
                    if cid not in held:  # a repeated row of the named document gives its stretches again
                        held[cid] = (span, n, weight > 1)
                        size += len(span)
        if held:
            yield answer(held)

    salt = F.when(F.col("members") > group, F.pmod(F.xxhash64("cid"), F.lit(1 << 20))).otherwise(0)
    return stretches.repartition("grp", salt).sortWithinPartitions("grp").mapInArrow(run, _ANSWER)


def _halves(stretches: DataFrame, length: int) -> DataFrame:
    """Both halves of the anchor places of each stretch, keyed by what all strings of a
    half share, with the ``parent`` and its starts that come before (``shift``)."""
    mid = F.expr("div(low + high, 2)").cast("int")
    half = stretches.select("*", F.explode(F.array(
        F.struct(F.col("low").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("high").alias("b")))).alias("half"))
    half = half.select("*", F.greatest(F.lit(0), F.expr("place - half.b")).alias("x"), F.least(F.expr("n - 1"), F.expr("place - half.a")).alias("y"))
    half = half.where("x <= y").select(
        F.col("cid").alias("parent"), F.col("x").cast("long").alias("shift"), "weight",
        F.expr("y - x + 1").alias("n"), F.expr("place - x").alias("place"), F.col("half.a").alias("low"), F.col("half.b").alias("high"),
        F.expr(f"substring(span, x + 1, y - x + {length})").alias("span"),
        F.expr(f"xxhash64(grp, half.a, substring(span, place - half.a + 1, half.a - half.b + {length}))").alias("grp"))
    key = F.unhex(F.substring(F.sha2(F.concat("span", F.encode(F.concat_ws(",", "grp", "place"), "UTF-8")), 256), 1, 32))
    return half.withColumn("cid", key)


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, mark, spans``: per document the byte spans ``start, end`` (may overlap) whose
    strings of ``length`` bytes also start elsewhere; ``rows`` has ``doc_id, mark, text``."""
    every = save(cells(rows, length, gram), "suffix-cells")
    anchors = save(every.groupBy("grp").count().where("count > 1").select("grp"), "suffix-anchors")
    found = save(every.join(anchors, "grp", "left_semi"), "suffix-repeated")
    name = F.min(F.struct("doc_id", "mark", "start"))
    stretches = found.groupBy("grp", "cid", "n", "place").agg(F.count("*").alias("weight"), name.alias("at"))
    stretches = save(_sized(stretches).select("*", "at.*").drop("at"), "suffix-stretches")
    answers, parents = [], []
    todo = _with_text(stretches, rows, length, gram)
    while True:
        done = save(_shards(todo, length, group), "suffix-shards")
        answers.append(done.where("from is not null").select("cid", "from", "to"))
        large = done.where("from is null")
        if large.isEmpty():
            break
        halves = save(_halves(large, length), "suffix-halves")
        parents.append(halves.select("cid", "parent", "shift"))
        todo = _sized(halves.groupBy("grp", "cid", "n", "place", "low", "high").agg(F.sum("weight").alias("weight"), F.first("span").alias("span")))
        todo = todo.select(*[f.split()[0] for f in _STRETCH.split(", ")])
    starts = answers.pop()
    while parents:
        up = starts.join(parents.pop(), "cid").select(
            F.col("parent").alias("cid"), (F.col("from") + F.col("shift")).alias("from"), (F.col("to") + F.col("shift")).alias("to"))
        starts = answers.pop().unionByName(up)
    spans = found.join(starts, "cid").select("doc_id", "mark", (F.col("start") + F.col("from")).alias("start"),
                                             (F.col("start") + F.col("to") - 1 + length).alias("end"))
    return spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` for every row of ``docs(doc_id, text)``: the maximal
    removed runs as a flat list start, end, ... and the remaining bytes."""
    import pyspark.sql.pandas.types as types
    if not 0 < gram < length < BLOCK // 2:
        raise ValueError("need 0 < gram < length < BLOCK / 2")
    rows = _identity(docs)
    spans = repeats(rows, length, gram, group)
    joined = rows.join(spans, _same_document(rows, spans), "left").select(rows["doc_id"], "text", "spans")
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", types.to_arrow_type(kind)), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.int64())), ("kept", pa.binary())])

    def run(batch: pa.RecordBatch):
        out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_bytes": [], "removed": [], "kept": []}
        for text, found in zip(batch.column("text"), batch.column("spans")):
            text = text.as_buffer().to_pybytes()
            runs: list[int] = []
            if found.is_valid:
                low, high = (found.values.field(c).to_numpy() for c in ("start", "end"))
                for a, b in sorted({*zip(low.tolist(), high.tolist())}):
                    if runs and a <= runs[-1]:
                        runs[-1] = max(runs[-1], b)
                    else:
                        runs += [a, b]
            edges = [0, *runs, len(text)]
            out["n_bytes"].append(len(text))
            out["removed"].append(runs)
            out["kept"].append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        return out

    return joined.mapInArrow(arrow_map(run, schema), f"doc_id {kind.simpleString()}, n_bytes long, removed array<long>, kept binary")


@register("op12_suffix_array_dedup")
def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in no repeated string of 400 bytes."""
    done = remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                       F.expr("size(removed) div 2").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
