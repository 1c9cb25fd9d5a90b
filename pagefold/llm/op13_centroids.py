"""Centroid clustering by a bisector tournament (operator 13).

Vectors become integers, ``floor(64 x)`` per component, so every comparison is
exact.  For each pair of centroids ``a < b`` the bisecting plane is prepared as an
integer normal ``2 (b - a)`` and a threshold ``|b|^2 - |a|^2``: a vector lies nearer to
``b`` where its product with the normal exceeds the threshold.  A vector starts with
centroid 0 and meets 1, 2, ... in turn, each meeting one sign test, and zero favours
the smaller number; after k - 1 tests only the nearest is left and its distance is
computed exactly.

Each round is one pass over the table: tasks add up their vectors per centroid, the
sums (centroids x components numbers a task) are added by Spark, and only those of
all tasks together reach the driver.  Tests use floating point where every product
and sum stays below 2^53 and hence is exact, else 64-bit, else unbounded integers.

Cases: vectors that are null, of another length, or with null or non-finite entries
are left out, and so are those with an entry beyond 2^53 / 64, which has no exact
integer; a null id gives a row and comes last in the choice of first centroids;
repeated rows each take part; with fewer vectors than ``k`` there are as many
centroids; equal centroids leave the smaller number all vectors; a sum beyond a long
is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import arrow_map, read, save
from pagefold.plans.catalog import register

K = 16
ROUNDS = 3
COMPONENTS = 64
LARGEST = 2.0 ** 53 / 64


def usable(embedding: Column, components: int | None = None) -> Column:
    """True for vectors whose every entry has an exact integer."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= LARGEST))
    if components is not None:
        fine = fine & (F.size(embedding) == components)
    return F.coalesce(fine, F.lit(False))


def integers(vectors: pa.Array, components: int) -> np.ndarray:
    """``floor(64 x)`` of an Arrow list column without nulls, one row per vector."""
    return np.floor(64 * vectors.flatten().to_numpy().astype("f8")).astype("i8").reshape(-1, components)


def exact(bound: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in the fastest type in which numbers up to ``bound`` are exact."""
    kind = "f8" if bound < 1 << 53 else "i8" if bound < 1 << 63 else object
    return [a.astype(kind) for a in arrays]


def _most(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


class Tournament:
    """The bisecting planes of a list of integer centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, "i8")
        wide = self.centroids.astype(object)
        norms = (wide * wide).sum(1)
        #: Plane of ``a`` and ``b`` at [a, b].
        self.normal = 2 * (self.centroids[None, :] - self.centroids[:, None])
        self.threshold = norms[None, :] - norms[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each row."""
        bound = x.shape[1] * _most(x) * _most(self.normal) + int(np.abs(self.threshold).max())
        x, normal, threshold = exact(bound, x, self.normal, self.threshold)
        winner = np.zeros(len(x), "i8")
        for other in range(1, len(self.centroids)):
            side = (x * normal[winner, other]).sum(1) > threshold[winner, other]
            winner[side] = other
        return winner

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distance of each row to centroid ``which``."""
        apart = x - self.centroids[which]
        apart, = exact(x.shape[1] * _most(apart) ** 2, apart)
        return (apart * apart).sum(1)


def first_centroids(vectors: DataFrame, k: int, seed: int, components: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of seed and id, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    return [integers(pa.array([r[0]], pa.list_(pa.float64())), components)[0].tolist() for r in rows]


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floor of the mean of each centroid's vectors; one without vectors stays."""
    components = len(centroids[0])
    tournament = Tournament(centroids)
    schema = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last column counts.
        totals = np.zeros((len(centroids), components + 1), object)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                x = integers(batch.column(0).slice(at, 512), components)
                which = tournament.nearest(x)
                for c in np.unique(which).tolist():
                    mine = x[which == c]
                    totals[c, :-1] += mine.sum(0)  # 512 numbers of 54 bits
                    totals[c, -1] += len(mine)
        cluster, component = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(component, pa.int32()), pa.array(
            [Decimal(int(t)) for t in totals[cluster, component]], pa.decimal128(38, 0))], schema=schema)

    sums = vectors.select("embedding").mapInArrow(run, "cluster int, component int, total decimal(38,0)")
    totals = np.zeros((len(centroids), components + 1), object)
    for cluster, component, total in sums.groupBy("cluster", "component").agg(F.sum("total")).collect():
        totals[cluster, component] = int(total)
    return [[int(t) // int(row[-1]) for t in row[:-1]] if row[-1] else old for row, old in zip(totals, centroids)]


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    import pyspark.sql.pandas.types as types
    components = len(centroids[0])
    tournament = Tournament(centroids)
    kind = vectors.schema["vec_id"].dataType
    schema = pa.schema([("vec_id", types.to_arrow_type(kind)), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batch: pa.RecordBatch):
        x = integers(batch.column("embedding"), components)
        which = tournament.nearest(x)
        far = tournament.distances(x, which).tolist()
        return {"vec_id": batch.column("vec_id"), "cluster": which, "distance": [int(d) if d < 1 << 63 else None for d in far]}

    return vectors.select("vec_id", "embedding").mapInArrow(arrow_map(run, schema), f"vec_id {kind.simpleString()}, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, components: int = COMPONENTS) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every usable vector, and the final centroids."""
    vectors = embeddings.where(usable(F.col("embedding"), components)).select("vec_id", "embedding")
    centroids = first_centroids(vectors, k, seed, components)
    if not centroids:
        return vectors.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    return assign(vectors, centroids), centroids


def report(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, components: int = COMPONENTS) -> DataFrame:
    """Every vector's cluster and distance with the sums over its cluster and over all."""
    assigned, centroids = cluster(embeddings, k, rounds, seed, components)
    assigned = save(assigned, "centroid-assigned")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: None if r["missing"] else int(r["total"]) for r in assigned.groupBy("cluster").agg(
        F.count_if(F.col("distance").isNull()).alias("missing"), whole.alias("total")).collect()}
    fits = lambda n: n if n is not None and n < 1 << 63 else None
    inertia = None if None in sums.values() else fits(sum(sums.values()))
    facts = [(c, fits(t), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, t in sums.items()]
    facts = embeddings.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(  # one row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    nearest = """a{n} AS MATERIALIZED (SELECT r, min(d * 16 + k) AS m FROM (
  SELECT r, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM pts CROSS JOIN c{n}) GROUP BY r)"""
    means = """c{m} AS MATERIALIZED (SELECT c{n}.k, coalesce(new.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
  SELECT k, list(f ORDER BY i) AS c FROM (
    SELECT m % 16 AS k, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS f
    FROM a{n} JOIN pts USING (r) CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2) GROUP BY k) new USING (k))"""
    steps = ["""pts AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
             """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST) - 1 AS k, x AS c FROM pts
  ORDER BY k LIMIT 16)"""]
    for n in range(ROUNDS):
        steps += [nearest.format(n=n), means.format(n=n, m=n + 1)]
    steps.append(nearest.format(n=ROUNDS))
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.m % 16 AS INTEGER) AS cluster, CAST(a.m // 16 AS BIGINT) AS distance,
  CAST(sum(a.m // 16) OVER (PARTITION BY a.m % 16) AS BIGINT) AS cluster_inertia, CAST(sum(a.m // 16) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN pts USING (r) JOIN c{ROUNDS} c ON a.m % 16 = c.k"""


@register("op13_centroid_clustering", oracle=_oracle())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds."""
    return report(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
