"""SimHash near-duplicates with BK-trees (operator 3).

1. ``fingerprint``: 64-bit SimHash over the XXH64 (seed 42) of every word
   shingle of the whole text.  Equal fingerprints meet in one row before
   anything is compared, so a group of copies costs one fingerprint.
2. Shards: the 64 bits fall into ``radius + 2`` blocks; two fingerprints within
   the radius agree in at least two of them, so they share a shard ``(pair of
   blocks, their bits)``.  A shard of more than ``tree_size`` fingerprints is
   cut once more in the same way over its remaining bits; with 64 bits and
   radius 2 that leaves 16 free bits, so no shard ever holds more than 65,536.
3. Every shard gets a BK-tree: children hang at the integer Hamming distance to
   their parent, and a query follows only the edges within the radius of its
   own distance.  The tree goes to the shard's own fingerprints, its only
   possible partners, not to every executor: broadcasting all trees would grow
   with the corpus.  A shard answers with a spanning star of each group found
   (at most one link per member), never with all pairs.
4. Connected components join the stars.

Cases: a null or empty text has fingerprint zero and links like any other;
rows with null ids take part, and ``component_id`` is the smallest id that is
not null (null only where the component has none); repeated rows each give a
row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import connected_components, read, save, text_column
from pagefold.plans.catalog import register

SHINGLE = 3
RADIUS = 2
TREE_SIZE = 4096
#: Shingle hashes counted at once; bounds the bit matrix of a very long text.
HASHES_AT_ONCE = 1 << 16


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text; zero without words."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends]
    spans = zip(starts, ends[shingle - 1:]) if len(words) >= shingle else [(0, len(joined) + 1)]
    hashes = np.array([xxh64_intdigest(joined[a:b - 1], 42) for a, b in spans], "<u8")
    ones = np.zeros(64, "i8")
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at:at + HASHES_AT_ONCE]
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long column."""
    return text_column(lambda texts: np.array([simhash(t, shingle) for t in texts], "<u8").view("<i8"), "long", pa.int64())(text)


def _masks(bits: list[int], radius: int) -> list[tuple[int, list[int]]]:
    """``(mask, bits left over)`` for every pair of ``radius + 2`` blocks of ``bits``."""
    blocks = [list(b) for b in np.array_split(bits, radius + 2)]
    out = []
    for i, j in combinations(range(len(blocks)), 2):
        used = blocks[i] + blocks[j]
        out.append((sum(1 << int(b) for b in used), [b for b in bits if b not in used]))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(masks: dict[int, int]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias("shard"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))
                                        .alias("key")) for n, m in masks.items()]))


class BKTree:
    """Values under integer Hamming distances; children keyed by distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = []
        plain = values.tolist()
        for i, v in enumerate(plain):
            self.children.append({})
            at = 0
            while at != i:
                d = (plain[at] ^ v).bit_count()
                nxt = self.children[at].setdefault(d, i)
                if nxt == i:
                    break
                at = nxt

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(node, positions of queries within the radius)``; all queries walk together,
        each only along the edges that its own distance allows."""
        stack = [(0, np.arange(len(queries)))] if self.children else []
        while stack:
            node, idx = stack.pop()
            d = np.bitwise_count(queries[idx] ^ self.values[node]).astype("i2")
            near = idx[d <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                go = idx[np.abs(d - edge) <= radius]
                if len(go):
                    stack.append((child, go))


def _stars(values: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Positions ``(root, member)`` of the groups linked within the radius."""
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for node, near in BKTree(values).within(values, radius):
        a = find(node)
        for q in near.tolist():
            b = find(q)
            if b != a:
                root[max(a, b)] = min(a, b)
                a = min(a, b)
    pairs = [(find(i), i) for i in range(len(values))]
    return [a for a, b in pairs if a != b], [b for a, b in pairs if a != b]


def links(prints: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """``src, dst`` between distinct fingerprints ``prints(fp)``: enough links to
    connect every two within the radius."""
    first = _masks(list(range(64)), radius)
    second = {}
    for n, (mask, rest) in enumerate(first):
        for k, (more, _) in enumerate(_masks(rest, radius)):
            second[n, k] = mask | more
    pairs = len(first)
    keyed = prints.select("fp", _keys({n: m for n, (m, _) in enumerate(first)}).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("shard", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(sizes, ["shard", "key"])
    small = members.where(F.col("n") <= tree_size).select("shard", "key", "fp")
    large = members.where(F.col("n") > tree_size)
    again = None
    for n in range(pairs):
        masks = {pairs + n * pairs + k: m for (p, k), m in second.items() if p == n}
        part = large.where(F.col("shard") == n).select("fp", _keys(masks).alias("k")).select("k.*", "fp")
        again = part if again is None else again.unionByName(part)
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(group: np.ndarray) -> pa.RecordBatch | None:
            if len(group) > 1:
                a, b = _stars(group.view("<u8"), radius)
                if a:
                    return pa.RecordBatch.from_arrays([pa.array(group[a]), pa.array(group[b])], schema=schema)
            return None

        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            shard, key, fp = (batch.column(c).to_numpy() for c in ("shard", "key", "fp"))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (key[1:] != key[:-1])) + 1
            for part in np.split(np.arange(len(fp)), cuts):
                if not len(part):
                    continue
                now = (shard[part[0]], key[part[0]])
                if now != last and held:
                    out = answer(np.concatenate(held))
                    if out is not None:
                        yield out
                    held = []
                last = now
                held.append(fp[part])
        if held:
            out = answer(np.concatenate(held))
            if out is not None:
                yield out

    return (small.unionByName(again).repartition("shard", "key").sortWithinPartitions("shard", "key", "fp")
            .mapInArrow(trees, "src long, dst long"))


def classes(rows: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """``fp, component_id, keeper_fp`` per distinct fingerprint of ``rows(doc_id, fp)``.

    ``keeper_fp`` belongs to the component's smallest id (null ids last, then
    the smallest fingerprint): the pair names the one row that stands for the group.
    """
    prints = save(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-prints")
    parts = connected_components(links(prints.select("fp"), radius, tree_size), "simhash-links")
    in_part = prints.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    keeper = in_part.groupBy("component").agg(
        F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("k"))
    return in_part.join(keeper, "component").select(
        "fp", F.col("k.low").alias("component_id"), F.col("k.fp").alias("keeper_fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``."""
    rows = save(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "simhash-rows")
    return rows.join(classes(rows, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, all columns kept: the one with the smallest id.

    Keepers are chosen on ids, text hashes and fingerprints; texts move once, in the join
    that picks the keepers' rows.  Rows that share id and fingerprint are the same
    document; one of them stays.
    """
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    rows = save(docs.select("doc_id", mark.alias("mark"), fingerprint(F.col("text"), shingle).alias("fp")), "simhash-rows")
    keepers = classes(rows, radius).groupBy("keeper_fp").agg(F.min("component_id").alias("keeper_id"))
    named = rows.groupBy("doc_id", "fp", "mark").agg(F.count("*").alias("n"))
    named = named.join(keepers, named["doc_id"].eqNullSafe(keepers["keeper_id"]) & (named["fp"] == keepers["keeper_fp"]), "left_semi")
    keep = save(named.groupBy("doc_id", "fp").agg(F.min(F.struct("mark", "n")).alias("k")).select("doc_id", "k.*"), "simhash-keepers")

    def kept(these: DataFrame) -> DataFrame:
        marked = docs.withColumn("__mark", mark)
        return marked.join(these, marked["doc_id"].eqNullSafe(these["doc_id"]) & (marked["__mark"] == these["mark"]), "left_semi")
    once, repeated = kept(keep.where("n = 1")), keep.where("n > 1")
    if not repeated.isEmpty():
        once = once.unionByName(kept(repeated).dropDuplicates(["doc_id", "__mark"]))
    return once.select(*docs.columns)


@register("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
