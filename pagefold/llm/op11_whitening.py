"""Embedding whitening by a hand-made symmetric eigensolver (operator 11).

1. Vectors become integers, ``floor(64 c) + 1000000``; the fit list holds each
   distinct one once.
2. Distributed centred covariance: exact sums first, then every task multiplies its
   centred rows ``(n x - S) / n`` (integer difference, one rounding) and Spark adds the
   products, components x components numbers a task.
3. Eigenpairs of that matrix, whose size is the vector's length and not the table's:
   Householder reflections make it tridiagonal, bisection on Sturm counts finds the
   leading eigenvalues, inverse iteration their vectors, made orthogonal again within
   clusters of close eigenvalues; the reflections carry the vectors back.
4. The components are broadcast and every row is projected.

Cases: vectors that are null or hold null or non-finite entries are left out, and so
are those with an entry beyond 2^53 / 64, which has no exact integer, and those of
another length than most (of two equally frequent lengths the longer counts).  Repeated
rows and null ids give rows each.  Only components whose eigenvalue is above
``RANK`` of the largest can be whitened: fewer rows come back for vectors in a smaller
space, none where all are equal or the table is empty.  A deviation beyond a long is
null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import SLICE_ROWS, arrow_map, read, save
from pagefold.plans.catalog import register

COMPONENTS = 16
SHIFT = 1_000_000
LARGEST = 2.0 ** 53 / 64
#: Smallest eigenvalue that counts, as a share of the largest.
RANK = 1e-11
#: Eigenvalues this close, as a share of the matrix's norm, are a cluster.
CLOSE = 1e-3
EPS = np.finfo("f8").eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, side diagonal and Householder vectors of a symmetric matrix."""
    a = np.array(matrix, "f8")
    mirrors: list[np.ndarray | None] = []
    for k in range(len(a) - 2):
        column = a[k + 1:, k].copy()
        if not column[1:].any():
            mirrors.append(None)
            continue
        scale = np.abs(column).max()
        image = -np.copysign(scale * np.linalg.norm(column / scale), column[0])
        u = column / scale
        u[0] -= image / scale
        u /= np.linalg.norm(u)
        rest = a[k + 1:, k + 1:]
        p = rest @ u
        p -= u * (u @ p)
        rest -= 2 * (np.outer(u, p) + np.outer(p, u))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = image
        mirrors.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def count_below(diagonal: np.ndarray, side: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sturm count: the number of eigenvalues below each shift."""
    least = np.finfo("f8").tiny * max(1.0, float(np.max(side ** 2, initial=0)))
    q = diagonal[0] - shifts
    count = (q < 0).astype("i8")
    for k in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[k] - shifts - side[k - 1] ** 2 / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, side: np.ndarray, number: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection until no double lies between the bounds."""
    reach = np.append(np.abs(side), 0) + np.append(0, np.abs(side))
    low = np.full(number, (diagonal - reach).min())
    high = np.full(number, (diagonal + reach).max())
    margin = 4 * EPS * max(abs(low[0]), abs(high[0])) + np.finfo("f8").tiny
    low, high = low - margin, high + margin
    wanted = len(diagonal) - np.arange(number)
    while True:
        middle = low + (high - low) / 2
        open_ = (low < middle) & (middle < high)
        if not open_.any():
            return middle
        above = count_below(diagonal, side, middle) >= wanted
        high = np.where(open_ & above, middle, high)
        low = np.where(open_ & ~above, middle, low)


def solve_shifted(diagonal: np.ndarray, side: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """``(T - shift) x = right`` by elimination with row exchanges; a zero pivot becomes tiny."""
    n = len(diagonal)
    norm = max(float(np.abs(diagonal).max()), float(np.max(np.abs(side), initial=0)), np.finfo("f8").tiny)
    d, up, far = (diagonal - shift).tolist(), [*side.tolist(), 0.0], [0.0] * n
    x = right.tolist()
    for k in range(n - 1):
        below = float(side[k])
        if abs(d[k]) >= abs(below):
            factor = below / d[k] if d[k] else 0.0
            d[k + 1] -= factor * up[k]
            x[k + 1] -= factor * x[k]
        else:
            factor = d[k] / below
            d[k], d[k + 1], up[k] = below, up[k] - factor * d[k + 1], d[k + 1]
            far[k], up[k + 1] = up[k + 1], -factor * up[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
    for k in range(n - 1, -1, -1):
        for step, row in ((1, up), (2, far)):
            if k + step < n:
                x[k] -= row[k] * x[k + step]
        x[k] /= d[k] if abs(d[k]) > EPS * norm else EPS * norm
    return np.array(x)


def tridiagonal_vectors(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector (column) of each of the falling ``values`` by inverse iteration."""
    rng = np.random.default_rng(11)
    norm = float(np.abs(diagonal).max() + 2 * np.max(np.abs(side), initial=0))
    vectors = np.empty((len(diagonal), len(values)))
    shift = np.inf
    for k, value in enumerate(values.tolist()):
        cluster = vectors[:, :k][:, values[:k] - value <= CLOSE * norm]
        # Equal shifts would find the same vector first.
        shift = min(value, shift - 10 * EPS * norm)
        x = rng.standard_normal(len(diagonal))
        for _ in range(6):
            x /= np.abs(x).max()
            x = solve_shifted(diagonal, side, shift, x)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= cluster @ (cluster.T @ x)
            x /= np.linalg.norm(x)
        vectors[:, k] = x
    return vectors


def leading_eigenpairs(matrix: np.ndarray, number: int, rank: float = RANK) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns;
    fewer than ``number`` where the matrix has a smaller rank."""
    diagonal, side, mirrors = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, side, min(number, len(diagonal)))
    values = values[(values > 0) & (values > rank * values.max(initial=0))]
    vectors = tridiagonal_vectors(diagonal, side, values)
    for k in range(len(mirrors) - 1, -1, -1):
        u = mirrors[k]
        if u is not None:
            vectors[k + 1:] -= 2 * np.outer(u, u @ vectors[k + 1:])
    return values, vectors


@dataclass
class Model:
    """A fitted projection; its size depends on the vectors' length alone."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def integers(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x`` of all usable vectors."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST))
    x = F.transform("embedding", lambda c: F.floor(64 * c.cast("double")) + F.lit(SHIFT).cast("long"))
    rows = embeddings.where(F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("x"))
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (size["size"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` exactly."""
    small = n * (int(np.abs(x).max(initial=0)) + SHIFT) < 1 << 62
    return n * x.astype("i8" if small else object) - np.array(sums, "i8" if small else object)


def _total(rows: DataFrame, function, size: int) -> np.ndarray:
    """Sum over all rows of ``x`` of the square matrix that ``function`` makes of each slice."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                total += function(_matrix(batch.column(0).slice(at, SLICE_ROWS)))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel(), f.type) for c, f in zip((i, j, total), schema)], schema=schema)

    out = np.zeros((size, size))
    for i, j, v in rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return (out + out.T) / 2


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The leading eigenpairs of the covariance of the distinct vectors of ``rows(x)``."""
    distinct = save(rows.select("x").distinct(), "whitening-fit")
    schema = pa.schema([("i", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                x = _matrix(batch.column(0).slice(at, SLICE_ROWS))
                n, total = n + len(x), total + x.sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(
                [Decimal(int(t)) for t in total], pa.decimal128(38, 0)), pa.array([n] * len(total), pa.int64())], schema=schema)

    found = distinct.mapInArrow(run, "i int, total decimal(38,0), n long").groupBy("i").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("i").collect()
    if not found:
        return None
    n, sums = found[0]["n"], [int(r["total"]) for r in found]

    def products(x: np.ndarray) -> np.ndarray:
        y = _differences(x, n, sums).astype("f8") / n
        return y.T @ y

    covariance = _total(distinct, products, len(sums)) / n
    values, vectors = leading_eigenpairs(covariance, components)
    model = Model(n, sums, values, vectors, float(np.trace(covariance)))

    def whitened_products(x: np.ndarray) -> np.ndarray:
        z = model.whiten(_differences(x, n, sums).astype("f8") / n)
        return z.T @ z

    if len(values):
        white = _total(distinct, whitened_products, len(values)) / n
        model.identity_error = float(np.abs(white - np.eye(len(values))).max())
    return model


def project(rows: DataFrame, model: Model) -> DataFrame:
    """``vec_id, deviation, whitened`` (an array) of every row of ``rows(vec_id, x)``."""
    import pyspark.sql.pandas.types as types
    kind = rows.schema["vec_id"].dataType
    schema = pa.schema([("vec_id", types.to_arrow_type(kind)), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        model = shared.value
        away = _differences(_matrix(batch.column("x")), model.n, model.sums)
        apart = away if int(np.abs(away).max(initial=0)) ** 2 * away.shape[1] < 1 << 63 else away.astype(object)
        deviation = [int(d) if d < 1 << 63 else None for d in (apart * apart).sum(1).tolist()]
        return {"vec_id": batch.column("vec_id"), "deviation": deviation, "whitened": [*model.whiten(away.astype("f8") / model.n)]}

    return rows.select("vec_id", "x").mapInArrow(arrow_map(run, schema), f"vec_id {kind.simpleString()}, deviation long, whitened array<double>")


def whitening(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector of ``embeddings(vec_id, embedding)`` and component."""
    rows = integers(embeddings)
    model = fit(rows, components)
    if model is None or not len(model.values):
        model = Model(0, [], np.empty(0), np.empty((0, 0)), 0.0)
        projected = rows.select("vec_id", F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    else:
        projected = project(rows, model)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    return projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))


@register("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every vector."""
    return whitening(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
