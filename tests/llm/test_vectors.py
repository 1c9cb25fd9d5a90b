"""Whitening (operator 11) and centroid clustering (operator 13) against plain numpy and Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from pagefold.llm import op11_whitening as white
from pagefold.llm import op13_centroids as cen

VECTORS = "vec_id long, embedding array<float>, x int, cluster string, distance int, n int, cid string"


def table(dims, rows=300, seed=2):
    rng = random.Random(seed)
    out = [(k, [rng.gauss(0, 0.1 + 0.05 * j) for j in range(dims)]) for k in range(rows)]
    out += [(500 + k, out[k % 3][1]) for k in range(150)] + [out[4], out[4], (None, out[9][1])]
    out += [(800, None), (801, [None] * dims), (802, [math.nan] * dims), (803, [math.inf] + [0.0] * (dims - 1)), (804, [1e30] * dims),
            (805, [0.5] * (dims + 1)), (806, [])]
    return [(a, b, 1, "c", 2, 3, "i") for a, b in out], [(a, b) for a, b in out if a is None or a < 800]


@pytest.mark.parametrize("dims,sizes", [(1, 4), (2, 4), (5, 4), (24, 16), (64, 16)])
def test_eigenpairs(dims, sizes):
    rng = np.random.default_rng(dims)
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    for values in (np.arange(dims) + 1.0, np.repeat(2.0, dims), np.where(np.arange(dims) < dims // 2, 3.0, 1.0), 10.0 ** -np.arange(dims), np.eye(dims)[0]):
        matrix = (q * values) @ q.T
        matrix = (matrix + matrix.T) / 2
        e, v = white.leading_eigenpairs(matrix, sizes)
        want = np.linalg.eigvalsh(matrix)[::-1][:sizes]
        want = want[want > white.RANK * want.max()]
        assert len(e) == len(want) and np.abs(e - want).max() < 1e-13 * want[0] * dims
        assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-10 and np.abs(matrix @ v - v * e).max() < 1e-11 * want[0]
    assert len(white.leading_eigenpairs(np.zeros((dims, dims)), sizes)[0]) == 0


def test_sturm_count():
    rng = np.random.default_rng(3)
    d, e = rng.standard_normal(20), rng.standard_normal(19)
    e[7] = 0
    eig = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    shifts = np.linspace(-4, 4, 81)
    assert white.count_below(d, e, shifts).tolist() == [int((eig < s).sum()) for s in shifts]


@pytest.mark.parametrize("dims", [3, 20])
def test_whitening(spark, dims):
    given, used = table(dims)
    got = white.whitening(spark.createDataFrame(given, VECTORS).repartition(6)).collect()
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in used]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(row, sums)] for row in fit], "f8") / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1][:16], vectors[:, ::-1][:, :16]
    rows = {}
    for r in got:
        rows.setdefault((r["vec_id"], r["component"]), []).append(r)
    number = min(16, dims)
    assert len(got) == number * len(used)
    sign = {}
    for (vec_id, _), row in zip(used, x):
        z = (np.array([n * c - s for c, s in zip(row, sums)], "f8") / n) @ vectors / np.sqrt(e)
        for k in range(number):
            r = rows[vec_id, k + 1][0]
            assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(row, sums))
            if abs(z[k]) > 1e-3:
                assert sign.setdefault(k, np.sign(r["whitened"] * z[k])) * r["whitened"] == pytest.approx(z[k], rel=1e-7, abs=1e-9)
            assert r["explained"] == pytest.approx(e[k] / np.trace(centred.T @ centred / n), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_without_room(spark):
    def whiten(rows):
        return white.whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert whiten([]) == [] and whiten([(1, [0.5, 0.5])]) == [] and whiten([(1, [0.5]), (2, [0.5]), (3, [])]) == []
    flat = whiten([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)])  # one direction only
    assert len(flat) == 9 and {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)
    assert sum(r["whitened"] ** 2 for r in flat) == pytest.approx(9)
    wide = whiten([(k, [float(k) * 2.0 ** 43, 1.0]) for k in range(4)])
    assert [r["deviation"] for r in wide] == [None] * 4 and sum(r["whitened"] ** 2 for r in wide) == pytest.approx(4)


def brute_clusters(used, k, rounds):
    x = [[math.floor(64 * float(np.float32(c))) for c in v] for _, v in used]
    order = sorted(range(len(used)), key=lambda i: (used[i][0] is None, hashlib.sha256(f"1:{used[i][0]}".encode()).hexdigest(), used[i][1]))
    centroids = [x[i] for i in order[:k]]
    for step in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x]
        which = [d.index(min(d)) for d in far]
        if step < rounds:
            for c in range(len(centroids)):
                mine = [v for v, w in zip(x, which) if w == c]
                if mine:
                    centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    inertia = [sum(d[w] for d, w in zip(far, which) if w == c) for c in range(len(centroids))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(u[0], w, d[w], inertia[w], sum(inertia), name[w]) for u, w, d in zip(used, which, far)]


@pytest.mark.parametrize("dims,k,rounds", [(64, 16, 3), (3, 7, 2), (2, 600, 1)])
def test_clusters(spark, dims, k, rounds):
    given, used = table(dims)
    got = cen.report(spark.createDataFrame(given, VECTORS).repartition(6), k, rounds, components=dims).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_clusters(used, k, rounds), key=repr)
    assert cen.report(spark.createDataFrame([], VECTORS)).collect() == []


def test_tournament_is_exact():
    rng = random.Random(5)
    for top in (3, 1 << 20, 1 << 30, 1 << 52):
        centroids = [[rng.randint(-top, top) for _ in range(3)] for _ in range(9)]
        centroids += [centroids[2], [-c for c in centroids[0]]]
        rows = [[rng.randint(-top, top) for _ in range(3)] for _ in range(60)] + [*centroids, [0, 0, 0]]
        t = cen.Tournament(centroids)
        which = t.nearest(np.array(rows))
        want = [[sum((a - b) ** 2 for a, b in zip(r, c)) for c in centroids] for r in rows]
        assert which.tolist() == [d.index(min(d)) for d in want]
        assert [int(d) for d in t.distances(np.array(rows), which)] == [min(d) for d in want]
