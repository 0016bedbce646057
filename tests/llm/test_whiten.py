"""Embedding whitening against the plain dense computation."""

import math
import random

import numpy as np
import pytest

from tallyspark.llm.whiten import SHIFT, largest_values, leading_eigen, smaller, tridiagonal, whiten

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "diagonal", "rank_one", "one", "two"])
def test_leading_eigen(kind):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    spectrum = {"random": rng.uniform(0, 9, 40), "clustered": np.r_[5 + 1e-9 * np.arange(6), rng.uniform(0, 1, 34)],
                "equal": np.r_[3.0, 3.0, 3.0, np.ones(37)], "rank_one": np.r_[7.0, np.zeros(39)]}
    a = {"diagonal": np.diag(np.arange(40.0)), "one": np.array([[4.0]]), "two": np.array([[2.0, 1.0], [1.0, 2.0]])}.get(kind)
    if a is None:
        a = (q * spectrum[kind]) @ q.T
        a = (a + a.T) / 2
    values, basis = leading_eigen(a, 8)
    k = min(8, len(a))
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-12 * max(1, np.abs(a).max()))
    assert np.allclose(basis.T @ basis, np.eye(k), atol=1e-12)
    assert np.abs(a @ basis - basis * values).max() < 1e-12 * np.abs(a).max() * len(a)


def test_sturm_counts():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    d, e, _ = tridiagonal(a + a.T)
    exact = np.linalg.eigvalsh(a + a.T)
    points = np.linspace(exact[0] - 1, exact[-1] + 1, 50)
    assert smaller(d, e, points).tolist() == [(exact < p).sum() for p in points]
    assert np.allclose(largest_values(d, e, 30), exact[::-1])


def check(spark, rows, schema="vec_id long, embedding array<float>, label int, n string", size=None):
    got = whiten(spark.createDataFrame(rows, schema).repartition(3)).collect()
    vectors = [r for r in rows if r[1] and all(x is not None and math.isfinite(np.float32(x)) for x in r[1]) and len(r[1]) == size]
    x = np.array([[math.floor(float(np.float32(c)) * 1024) + SHIFT for c in r[1]] for r in vectors], object)
    n, k = len(x), min(8, size)
    sums = x.sum(axis=0)
    y = (x - sums / n).astype(float)
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    assert len(got) == n * k and {r.n for r in got} == {n}
    want = {}
    for r, row, flat in zip(vectors, x, y):
        deviation = sum(int(n * c - s) ** 2 for c, s in zip(row, sums))
        for j in range(k):
            want.setdefault((r[0], j + 1), []).append((deviation, abs(flat @ u[:, j] / math.sqrt(e[j]))))
    have = {}
    for r in got:
        have.setdefault((r.vec_id, r.component), []).append((int(r.deviation_exact), abs(r.whitened)))
        assert r.deviation == (int(r.deviation_exact) if r.deviation_exact < 1 << 63 else None)
        assert math.isclose(r.explained, e[r.component - 1] / np.trace(v), rel_tol=1e-9) and r.identity_error < 1e-9
    assert have.keys() == want.keys()
    for key in want:
        for (a, b), (c, d) in zip(sorted(have[key]), sorted(want[key])):
            assert a == c and abs(b - d) < 1e-8, key


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1 * (j + 1)) for j in range(12)], i, "x") for i in range(300)]
    rows += [(7, rows[7][1], 0, "x"), (None, rows[9][1], 0, "x"), (1000, None, 0, "x"), (1001, [], 0, "x"),
             (1002, [1.0] * 11 + [None], 0, "x"), (1003, [float("nan")] * 12, 0, "x"), (1004, [float("inf")] * 12, 0, "x"), (1005, [1.0] * 3, 0, "x")]
    check(spark, rows, size=12)
    check(spark, [(i, [rng.gauss(0, 1), rng.gauss(5, 2)], 0, "x") for i in range(40)], size=2)


def test_wide_deviations(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-2e6, 2e6, 1.0]) for _ in range(5)], 0, "x") for i in range(60)]
    check(spark, rows, size=5)


def test_given_table(spark):
    rows = [tuple(r) + ("x",) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check(spark, rows, size=64)


def test_no_variance_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    got = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(got) == 4 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in got)
    got = whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0])], schema)).collect()  # one component varies
    assert [(r.whitened is None) for r in sorted(got, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 2
    assert {abs(r.whitened) for r in got if r.component == 1} == {1.0}
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).columns[0] == "vec_id"
