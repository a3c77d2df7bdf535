"""Solvers and kernels against NumPy on small matrices."""

import numpy as np
import pytest

from lattica.functions import dense
from lattica.operators import matrix as M
from lattica.operators import solvers as S


def frame(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i long, j long, v double")


def laplacian(n, seed=3):
    r = np.random.default_rng(seed)
    w = np.triu((r.random((n, n)) < 0.2) * r.random((n, n)), 1)
    w = w + w.T
    return np.diag(w.sum(1) + np.linspace(1, 3, n)) - w


@pytest.fixture(scope="module")
def lap(spark):
    a = laplacian(40)
    return a, M.SparseMatrix(frame(spark, a), 40, 40)


def test_power(lap):
    a, m = lap
    x, want = np.full(40, 0.5), []
    for _ in range(5):
        y = a @ x
        want.append(np.linalg.norm(y))
        x = y / want[-1]
    assert np.allclose(S.power_norms(m, 5), want, rtol=1e-9)


def test_power_stops_at_zero(spark):
    z = M.SparseMatrix(spark.createDataFrame([], "i long, j long, v double"), 3, 3)
    assert S.power_norms(z, 4) == [0.0]


def test_lanczos(lap):
    a, m = lap
    alpha, beta = S.lanczos_coefficients(m, 6, reorth=2)
    q = [np.full(40, 40**-0.5)]
    for k in range(6):
        z = a @ q[k]
        assert np.isclose(alpha[k], q[k] @ z, rtol=1e-8)
        for _ in range(2):
            z = z - np.array(q).T @ (np.array(q) @ z)
        assert np.isclose(beta[k], np.linalg.norm(z), rtol=1e-7)
        q.append(z / np.linalg.norm(z))
    ritz = dense.tridiagonal_eigenvalues(alpha, beta)
    w = np.linalg.eigvalsh(a)
    assert (np.diff(ritz) >= 0).all() and w[0] - 1e-9 <= ritz[0] and ritz[-1] <= w[-1] + 1e-9


def test_lanczos_breaks_down_early(spark):
    m = M.SparseMatrix(M.identity(spark, 5), 5, 5)
    alpha, beta = S.lanczos_coefficients(m, 4)
    assert np.allclose(alpha, [1.0]) and beta[0] < 1e-12


def test_lobpcg(lap):
    a, m = lap
    lam, res, x = S.lobpcg_run(m, b=2, iterations=12, tol=1e-6)
    w = np.linalg.eigvalsh(a)[:2]
    last = [v for it, k, v in lam if it == lam[-1][0]]
    assert (np.array(last) >= w - 1e-9).all()
    first = [v for it, k, v in lam if it == 0]
    assert sum(last) < sum(first) and abs(last[0] - w[0]) < 0.05
    xs = np.array([r.x for r in x.orderBy("i").collect()])
    assert np.allclose(xs.T @ xs, np.eye(2), atol=1e-6)


def test_symmetry_and_missing_rows(spark):
    lower = spark.createDataFrame([(0, 0, 2.0), (2, 0, 1.0)], "i long, j long, v double")
    m = M.SparseMatrix(lower, 4, 4, "lower")
    x = spark.range(4).selectExpr("id AS i", "1.0D AS x")
    assert [r.x for r in m.full(m.times(x)).orderBy("i").collect()] == [3.0, 0.0, 1.0, 0.0]


def test_blocks_round_trip(spark):
    a = laplacian(30)
    b = M.to_blocks(frame(spark, a), 8)
    back = M.from_blocks(b, 8).collect()
    got = np.zeros((30, 30))
    for r in back:
        got[r.i, r.j] = r.v
    assert np.array_equal(got, a) and b.where("nnz = 0").count() == 0


def test_gram_over_empty_partitions(spark):
    x = spark.range(10).repartition(16).selectExpr("id AS i", "array(cast(id AS double), 1.0D) AS x")
    assert np.allclose(M.gram_arrays(x, 2), [[285, 45], [45, 10]])


def test_dense():
    r = np.random.default_rng(0)
    a, b = r.random((5, 5)), r.random((5, 5))
    a, b = a + a.T, b @ b.T + np.eye(5)
    w, v = dense.generalized_eigh(a, b)
    assert np.allclose(a @ v, b @ v * w) and np.allclose(v.T @ b @ v, np.eye(5))
    assert dense.cholesky_upper(-np.eye(3)) is None
