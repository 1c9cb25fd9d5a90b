"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import retrieval as R
from pagefold.plans.catalog import register
from pagefold.sources.tables import read_table

#: Below the operator's default of 0.7, which only copies reach in these vectors.
THRESHOLD = 0.3

SQL_VEC = """
vq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
scored AS (
  SELECT query_id, vec_id, label,
    CASE WHEN qn = 0 OR vn = 0 THEN 0.0e0 ELSE dot / (vn * qn) END AS score
  FROM (
    SELECT vq.query_id, e.vec_id, e.label,
      list_sum(list_transform(list_zip(e.embedding, vq.q), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS dot,
      sqrt(list_reduce(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0e0)) AS vn,
      sqrt(list_reduce(list_transform(vq.q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b, 0.0e0)) AS qn
    FROM embeddings e, vq)
)"""


def _vectors(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return e, q


@register("similar_topk", oracle=f"""
WITH {SQL_VEC}
SELECT query_id, vec_id, round(score, 9) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5""")
def similar_topk(spark, sf_dir):
    """Top 5 vectors for every 50th vector."""
    e, q = _vectors(spark, sf_dir)
    r = R.similar_topk(e, q, 5)
    return r.select("query_id", "vec_id", F.round("score", 9).alias("score"), "rank")


@register("similar_threshold", oracle=f"""
WITH {SQL_VEC}
SELECT query_id, vec_id, round(score, 9) AS score FROM scored WHERE round(score, 9) >= {THRESHOLD}e0""")
def similar_threshold(spark, sf_dir):
    """All vectors near every 50th vector."""
    e, q = _vectors(spark, sf_dir)
    return R.similar_threshold(e, q, THRESHOLD).select("query_id", "vec_id", F.round("score", 9).alias("score"))


@register("summary_effectiveness", oracle="""
SELECT doc_id, eff AS effectiveness,
  array_to_string(CASE WHEN eff < 0.5 THEN ['Consider more aggressive content filtering']
                       WHEN eff > 0.8 THEN ['Excellent compression achieved - current settings are optimal']
                       ELSE ['No specific recommendations at this time'] END, ' | ') AS recommendations
FROM (SELECT doc_id, floor(least(len(string_split(text, ' ')) / 100.0e0, 1.0e0)
                     * least(len(string_split_regex(text, '[.!?]+')) / 10.0e0, 1.0e0) * 100 + 0.5e0) / 100 AS eff
      FROM documents)""")
def summary_effectiveness(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    eff = R.summary_effectiveness("text")
    return d.select("doc_id", eff.alias("effectiveness")).select(
        "doc_id", "effectiveness", F.array_join(R.effectiveness_advice(F.col("effectiveness")), " | ")
        .alias("recommendations"))


@register("topic_text_chunks", oracle="""
SELECT doc_id, chunk_idx, start, md5(substring(text, start, 1000)) AS chunk_md5 FROM (
  SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 200) / 800.0), 1) AS BIGINT))) AS chunk_idx
  FROM documents) t, LATERAL (SELECT chunk_idx * 800 + 1 AS start)""")
def topic_text_chunks(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    c = R.topic_text_chunks(d, "doc_id", "text")
    return c.select("doc_id", "chunk_idx", "start", F.md5("chunk").alias("chunk_md5"))
