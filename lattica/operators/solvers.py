"""Power iteration, Lanczos and LOBPCG as driver loops over DataFrame steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.dense import assemble, cholesky_upper, generalized_eigh, inverse_upper, symmetrize, tridiagonal_eigenvalues
from lattica.functions.storage import cut
from lattica.operators.matrix import BROADCAST_ROWS, SparseMatrix, _outer, spmm_arrays, times_dense


def _placed(a: SparseMatrix) -> DataFrame:
    """The entries, cached; by row if vectors are broadcast (sums then need no
    shuffle), by column if they are joined."""
    by = "i" if a.n_cols <= BROADCAST_ROWS else "j"
    return a.general().coo.repartition(by).persist()


#: Entries of a packed chunk of a matrix.
CHUNK = 1 << 19


class PackedMatrix:
    """A matrix whose vectors fit the driver (``BROADCAST_ROWS``), by row in chunks.

    A product broadcasts x and runs one NumPy kernel on each chunk; what comes
    back are the sums by row, a vector again. Chunks are cached; a lost one is made
    again from the entries.
    """

    def __init__(self, a: SparseMatrix) -> None:
        self.spark, self.n_rows = a.coo.sparkSession, a.n_rows

        def pack(batches):
            import pyarrow as pa

            def chunk(parts):
                i, j, v = (np.concatenate([p[k] for p in parts]) for k in range(3))
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (i[first], first, j, v)], names=["i", "first", "j", "v"])

            have, n = [], 0
            for b in batches:
                if b.num_rows:
                    have.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "v")])
                    n += b.num_rows
                if n >= CHUNK:
                    yield chunk(have)
                    have, n = [], 0
            if have:
                yield chunk(have)

        coo = a.general().coo.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
        self.chunks = coo.repartition("i").sortWithinPartitions("i").mapInArrow(pack, "i binary, first binary, j binary, v binary").persist()

    def times(self, x: np.ndarray) -> np.ndarray:
        shared = self.spark.sparkContext.broadcast(x)

        def kernel(batches):
            import pyarrow as pa

            for b in batches:
                for i, first, j, v in zip(*(b.column(c).to_pylist() for c in ("i", "first", "j", "v"))):
                    y = np.add.reduceat(np.frombuffer(v) * shared.value[np.frombuffer(j, np.int64)], np.frombuffer(first, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["i", "y"])

        y = np.zeros(self.n_rows)
        # A row that two chunks share comes twice: n_rows numbers and one a chunk.
        for r in self.chunks.mapInArrow(kernel, "i binary, y binary").toArrow().to_pylist():
            np.add.at(y, np.frombuffer(r["i"], np.int64), np.frombuffer(r["y"]))
        shared.destroy()
        return y

    def free(self) -> None:
        self.chunks.unpersist()


def _fits(a: SparseMatrix, vectors: int = 1) -> bool:
    """Whether vectors of the matrix fit a broadcast, and so many of them the driver (128 MB)."""
    n = max(a.n_rows, a.n_cols)
    return n <= BROADCAST_ROWS and n * vectors <= 1 << 24


def power_norms(a: SparseMatrix, iterations: int = 10, x0: float = 0.5) -> list[float]:
    """Norm of A x before each normalization, from a constant start."""
    if _fits(a):
        m, x, norms = PackedMatrix(a), np.full(a.n_cols, float(x0)), []
        for _ in range(iterations):
            y = m.times(x)
            norms.append(float(np.sqrt(y @ y)))
            if norms[-1] == 0.0:
                break
            x = y / norms[-1]
        m.free()
        return norms
    return _power_norms_joined(a, iterations, x0)


def _power_norms_joined(a: SparseMatrix, iterations: int, x0: float) -> list[float]:
    """The same for vectors of any length, as tables."""
    spark = a.coo.sparkSession
    coo = _placed(a)
    m = SparseMatrix(coo, a.n_rows, a.n_cols)
    x = spark.range(a.n_cols).select(F.col("id").alias("i"), F.lit(float(x0)).alias("x"))
    norms: list[float] = []
    for _ in range(iterations):
        y = cut(m.times(x))
        norm = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 0.0
        norms.append(norm)
        if norm == 0.0:
            break
        x = y.select("i", (F.col("x") / norm).alias("x"))
    coo.unpersist()
    return norms


def power_iteration(a: SparseMatrix, iterations: int = 10, x0: float = 0.5) -> DataFrame:
    norms = power_norms(a, iterations, x0)
    return a.coo.sparkSession.createDataFrame([(k, v) for k, v in enumerate(norms)], "iter int, norm double")


def lanczos_coefficients(a: SparseMatrix, steps: int, reorth: int = 1, eps: float = 1e-12) -> tuple[list[float], list[float]]:
    """Alpha and beta with ``reorth`` Gram-Schmidt passes over the whole basis. Stops early where beta vanishes."""
    if not _fits(a, steps + 1):
        return _lanczos_joined(a, steps, reorth, eps)
    m, q = PackedMatrix(a), [np.full(a.n_rows, float(a.n_rows) ** -0.5)]
    alpha: list[float] = []
    beta: list[float] = []
    for k in range(steps):
        z = m.times(q[k])
        for turn in range(max(1, reorth)):
            c = [float(x @ z) for x in q]
            if not turn:
                alpha.append(c[k])
            for x, w in zip(q, c):
                z = z - w * x
        beta.append(float(np.sqrt(z @ z)))
        if beta[-1] < eps:
            break
        q.append(z / beta[-1])
    m.free()
    return alpha, beta


def _lanczos_joined(a: SparseMatrix, steps: int, reorth: int, eps: float) -> tuple[list[float], list[float]]:
    """The same for vectors of any length: the basis is an array column, so a step shuffles only the product."""
    spark = a.coo.sparkSession
    coo = _placed(a)
    m = SparseMatrix(coo, a.n_rows, a.n_cols)
    q = spark.range(a.n_rows).select(F.col("id").alias("i"), F.array(F.lit(float(a.n_rows) ** -0.5)).alias("q"))
    alpha: list[float] = []
    beta: list[float] = []
    for k in range(steps):
        z = m.times(q.select("i", F.col("q")[k].alias("x")))
        s = cut(q.join(z, "i", "left").select("i", "q", F.coalesce("x", F.lit(0.0)).alias("z")))
        for turn in range(max(1, reorth)):
            c = s.agg(*[F.sum(F.col("q")[j] * F.col("z")).alias(f"c{j}") for j in range(k + 1)]).first()
            if not turn:
                alpha.append(c[k])
            s = s.withColumn("z", F.col("z") - sum((F.col("q")[j] * float(c[j]) for j in range(k + 1)), F.lit(0.0)))
        s = cut(s)
        b = float(np.sqrt(s.agg(F.sum(F.col("z") * F.col("z"))).first()[0]))
        beta.append(b)
        if b < eps:
            break
        q = s.select("i", F.concat("q", F.array(F.col("z") / b)).alias("q"))
    coo.unpersist()
    return alpha, beta


def lanczos(a: SparseMatrix, steps: int, reorth: int = 1) -> DataFrame:
    """(k, alpha, beta, ritz), Ritz values ascending."""
    alpha, beta = lanczos_coefficients(a, steps, reorth)
    ritz = tridiagonal_eigenvalues(alpha, beta)
    return a.coo.sparkSession.createDataFrame([(k, float(alpha[k]), float(beta[k]), float(ritz[k])) for k in range(len(alpha))], "k int, alpha double, beta double, ritz double")


def start_block(spark: SparkSession, n: int, b: int) -> DataFrame:
    """The start block of matrix.hashed_start() as (i, x array)."""
    x = [((F.col("id") * 7919 + k * 104729 + 12345) % 10007) / 10007.0 for k in range(b)]
    return spark.range(n).select(F.col("id").alias("i"), F.array(*x).alias("x"))


def lobpcg_run(a: SparseMatrix, b: int = 4, iterations: int = 10, tol: float = 1e-10, start: DataFrame | None = None) -> tuple[list[tuple], list[tuple], DataFrame]:
    """Smallest ``b`` eigenpairs, B = I, no preconditioner.

    Returns (iter, k, lambda) and (iter, k, residual norm) and the block X. X,
    its product and the search directions are array columns of one table, so
    only products with A shuffle; an iteration runs one product and two Gram jobs.
    """
    spark = a.coo.sparkSession
    coo = _placed(a)
    n = a.n_cols

    def product(t: DataFrame, column: str, width: int, name: str) -> DataFrame:
        y = spmm_arrays(coo, t.select("i", F.col(column).alias("x")), width, n).withColumnRenamed("x", name)
        return cut(t.join(y, "i", "left").withColumn(name, F.coalesce(name, F.array(*[F.lit(0.0)] * width))))

    t = start if start is not None else start_block(spark, n, b)
    r = cholesky_upper(_outer(t, [("x", b)])[0][0])
    if r is None:
        raise np.linalg.LinAlgError("the start block has dependent columns")
    t = product(t.select("i", times_dense("x", inverse_upper(r)).alias("x")), "x", b, "ax")
    lam, v = np.linalg.eigh(symmetrize(_outer(t, [("x", b), ("ax", b)])[0][1]))
    t = cut(t.select("i", times_dense("x", v).alias("x"), times_dense("ax", v).alias("ax")))
    lambdas: list[tuple] = []
    residuals: list[tuple] = []
    active = [True] * b
    have_p = False
    for it in range(iterations):
        res = F.array(*[F.col("ax")[k] - F.col("x")[k] * float(lam[k]) for k in range(b)])
        t = t.withColumn("r", res)
        sq = t.agg(*[F.sum(F.col("r")[k] * F.col("r")[k]).alias(f"n{k}") for k in range(b)]).first()
        norms = np.sqrt([s or 0.0 for s in sq])
        residuals += [(it, k, float(norms[k])) for k in range(b)]
        active = [on and bool(norms[k] > tol) for k, on in enumerate(active)]
        cols = [k for k in range(b) if active[k]]
        if not cols:
            break
        m = len(cols)
        t = t.withColumn("r", F.array(*[F.col("r")[k] for k in cols]))
        g = _outer(t, [("x", b), ("r", m)])
        t = t.withColumn("r", F.array(*[F.col("r")[q] - sum((F.col("x")[p] * float(g[0][1][p, q]) for p in range(b)), F.lit(0.0)) for q in range(m)]))
        t = cut(t)
        rr = cholesky_upper(_outer(t, [("r", m)])[0][0])
        if rr is None:
            break
        t = product(t.withColumn("r", times_dense("r", inverse_upper(rr))), "r", m, "ar")
        names = [("x", b), ("ax", b), ("r", m), ("ar", m)]
        if have_p:
            t = t.withColumn("p", F.array(*[F.col("p")[k] for k in cols])).withColumn("ap", F.array(*[F.col("ap")[k] for k in cols]))
            rp = cholesky_upper(_outer(t, [("p", m)])[0][0])
            if rp is None:
                break
            ip = inverse_upper(rp)
            t = cut(t.withColumn("p", times_dense("p", ip)).withColumn("ap", times_dense("ap", ip)))
            names += [("p", m), ("ap", m)]
        g = _outer(t, names)
        xar, rar = g[0][3], symmetrize(g[2][3])
        if have_p:
            ga = assemble([[np.diag(lam), xar, g[0][5]], [None, rar, g[2][5]], [None, None, symmetrize(g[4][5])]])
            gb = assemble([[np.eye(b), np.zeros((b, m)), g[0][4]], [None, np.eye(m), g[2][4]], [None, None, np.eye(m)]])
        else:
            ga, gb = assemble([[np.diag(lam), xar], [None, rar]]), np.eye(b + m)
        try:
            w, v = generalized_eigh(ga, gb)
        except np.linalg.LinAlgError:
            break
        lam, c = w[:b], v[:, :b]
        c1, c2 = c[:b], c[b : b + m]
        p, ap = times_dense("r", c2), times_dense("ar", c2)
        if have_p:
            c3 = c[b + m :]
            plus = lambda u, w: F.zip_with(u, w, lambda x, y: x + y)
            p, ap = plus(p, times_dense("p", c3)), plus(ap, times_dense("ap", c3))
        t = t.select("i", times_dense("x", c1).alias("x1"), times_dense("ax", c1).alias("ax1"), p.alias("p"), ap.alias("ap"))
        total = lambda u, w: F.zip_with(u, w, lambda x, y: x + y)
        t = cut(t.select("i", total("x1", "p").alias("x"), total("ax1", "ap").alias("ax"), "p", "ap"))
        have_p = True
        lambdas += [(it, k, float(lam[k])) for k in range(b)]
    coo.unpersist()
    return lambdas, residuals, t.select("i", "x")


def lobpcg(a: SparseMatrix, b: int = 4, iterations: int = 10, tol: float = 1e-10) -> DataFrame:
    out = lobpcg_run(a, b, iterations, tol)[0]
    return a.coo.sparkSession.createDataFrame(out, "iter int, k int, lambda double")
