"""Vector search over given embeddings and summary metrics.

Exact search as a product of blocks: queries and vectors are packed into rows of up
to ``BLOCK`` vectors, every pair of a query block and a vector block meets in a task by
an equi-join on both block numbers, and one matrix product scores the pair.  A block of
vectors is copied once per query block, not once per query; neither side is collected
and the number of queries is not limited.  Of a pair of blocks only the k best rows
per query, or those above the threshold, go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 2048
#: Digits of a score that count in an order: beyond them equal vectors may differ by the summation order.
DIGITS = 9


def _blocks(rows: DataFrame, key: str, block: int, others: int, number: str, other: str) -> DataFrame:
    """``rows(key, embedding, ...)`` packed by hash into blocks, each copied for ``others`` blocks of the other side."""
    count = max(1, -(-rows.count() // block))
    packed = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(count)).alias(number)).agg(F.collect_list(F.struct(*rows.columns)).alias(f"{number}s"))
    return packed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))


def _unit(rows: pa.StructArray) -> np.ndarray:
    """The vectors of a block at length one; a zero vector stays zero."""
    vectors = rows.field("embedding")
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(rows), -1)
    norm = np.sqrt((m * m).sum(1))[:, None]
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _scored(vectors: DataFrame, queries: DataFrame, pick: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> DataFrame:
    """``query_id, vec_id, label, score`` of the pairs that ``pick(scores, vector ids)`` names in each
    pair of blocks.  Vectors and queries that are null or of another length than most queries are left out."""
    size = queries.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    usable = F.coalesce((F.size("embedding") == (size["n"] if size else -1)) & F.forall("embedding", lambda x: x.isNotNull()), F.lit(False))
    vectors, queries = vectors.where(usable).select("vec_id", "label", "embedding"), queries.where(usable).select("query_id", "embedding")
    n_q, n_v = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    q = _blocks(queries, "query_id", block, n_v, "qb", "vb")
    v = _blocks(vectors, "vec_id", block, n_q, "vb", "qb")
    fields = [("query_id", queries), ("vec_id", vectors), ("label", vectors)]
    schema = pa.schema([(n, to_arrow_type(df.schema[n].dataType)) for n, df in fields] + [("score", pa.float64())])
    kind = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n, df in fields) + ", score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, other = batch.column("qbs")[k].values, batch.column("vbs")[k].values
                scores = _unit(one) @ _unit(other).T
                ids = other.field("vec_id").to_numpy(zero_copy_only=False)
                i, j = pick(np.round(scores, DIGITS), ids)
                yield pa.RecordBatch.from_arrays([one.field("query_id").take(pa.array(i)), other.field("vec_id").take(pa.array(j)),
                                                  other.field("label").take(pa.array(j)), pa.array(scores[i, j])], schema=schema)

    pairs = v.join(q, ["vb", "qb"]).select("vbs", "qbs")
    return pairs.mapInArrow(run, kind)


def similar_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``similar_topk``: the k most cosine-similar vectors per query."""
    def best(scores: np.ndarray, ids: np.ndarray):
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))[:, :k] if scores.shape[1] else np.empty((len(scores), 0), "i8")
        return np.repeat(np.arange(len(scores)), order.shape[1]), order.ravel()
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "vec_id")
    return _scored(vectors, queries, best).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similar_threshold(vectors: DataFrame, queries: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``similar_threshold``: all vectors with score >= threshold per query."""
    return _scored(vectors, queries, lambda scores, ids: np.nonzero(scores >= threshold))


def summary_effectiveness(text) -> Column:
    """``summary_effectiveness``: min(words/100,1) * min(sentences/10,1), 2 decimals."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.size(F.split(t, " "))
    sentences = F.size(F.split(t, "[.!?]+"))
    eff = F.least(words / F.lit(100.0), F.lit(1.0)) * F.least(sentences / F.lit(10.0), F.lit(1.0))
    return F.floor(eff * 100 + 0.5) / 100


def effectiveness_advice(eff: Column) -> Column:
    recs = F.array_compact(F.array(
        F.when(eff < 0.5, F.lit("Consider more aggressive content filtering")),
        F.when(eff > 0.8, F.lit("Excellent compression achieved - current settings are optimal"))))
    return F.when(F.size(recs) > 0, recs).otherwise(F.array(F.lit("No specific recommendations at this time")))


def topic_text_chunks(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``topic_text_chunks``: fixed windows of ``size`` chars every
    ``size - overlap`` chars over the whole text (posexplode per document)."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(float(step))), F.lit(1)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step + 1)
    return docs.select(key, text, F.posexplode(starts).alias("chunk_idx", "start")).select(
        key, "chunk_idx", "start", F.expr(f"substring({text}, start, {size})").alias("chunk"))
