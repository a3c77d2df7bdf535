"""The engine's queries and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators import matrix as M
from lattica.operators import partition as P
from lattica.operators import solvers as S
from lattica.plans import matrices as D

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df, column: str = "x", digits: int = 6):
    return df.withColumn(column, F.round(F.col(column).cast("double"), digits))


def _x(spark, n: int):
    """The vector x[i] = (i mod 7) + 1."""
    return spark.range(n).select(F.col("id").alias("i"), ((F.col("id") % 7) + 1).cast("double").alias("x"))


_XP = "X AS (SELECT i, ((i % 7) + 1)::DOUBLE AS x FROM range(0, (SELECT max(p_partkey) + 1 FROM part)) t(i))"
_XB = "XB AS (SELECT i, k::INTEGER AS k, (((i * 7919 + k * 104729 + 12345) % 10007) / 10007.0::DOUBLE) AS x FROM range(0, (SELECT max(p_partkey) + 1 FROM part)) t(i), range(0, 4) u(k))"


# Sparse products


@query(f"WITH {D.COPURCHASE}, {_XP} SELECT A.i, round(sum(v * x), 6) AS x FROM A JOIN X ON A.j = X.i GROUP BY A.i")
def spmv(spark, d):
    n = D.n_parts(spark, d)
    return _rounded(M.spmv(D.copurchase(spark, d), _x(spark, n), n))


@query(_SQL["spmv"])
def spmv_csb(spark, d):
    n = D.n_parts(spark, d)
    a = M.from_blocks(M.to_blocks(D.copurchase(spark, d), 64), 64)
    return _rounded(M.spmv(a, _x(spark, n), n))


@query(f"WITH {D.COPURCHASE}, {_XB} SELECT A.i, k, round(sum(v * x), 6) AS x FROM A JOIN XB ON A.j = XB.i GROUP BY A.i, k")
def spmm(spark, d):
    n = D.n_parts(spark, d)
    return _rounded(M.spmm(D.copurchase(spark, d), M.hashed_start(spark, n, 4), n, 4))


@query(_SQL["spmm"])
def spmm_array(spark, d):
    n = D.n_parts(spark, d)
    y = M.spmm_arrays(D.copurchase(spark, d), S.start_block(spark, n, 4), 4, n)
    return _rounded(y.select("i", F.posexplode("x").alias("k", "x")))


@query(f"WITH {D.INCIDENCE}, {_XB} SELECT B.i, k, round(sum(v * x), 6) AS x FROM B JOIN XB ON B.j = XB.i GROUP BY B.i, k")
def spmm_rect(spark, d):
    n = D.n_parts(spark, d)
    return _rounded(M.spmm(D.incidence(spark, d), M.hashed_start(spark, n, 4), n, 4))


@query(f"WITH {D.TRADE} SELECT i, sum(v * (j % 5 + 1)) AS x FROM M GROUP BY i")
def matvec_dense(spark, d):
    x = spark.range(25).select(F.col("id").alias("i"), (F.col("id") % 5 + 1).cast("double").alias("x"))
    return M.spmv(D.trade(spark, d), x, 25)


@query("SELECT i, sum((10 * i + j) * (j % 3 + 1))::DOUBLE AS x FROM range(0, 256) a(i), range(0, 256) b(j) GROUP BY i")
def dense_grid_matvec(spark, d):
    x = spark.range(256).select(F.col("id").alias("i"), (F.col("id") % 3 + 1).cast("double").alias("x"))
    return M.spmv(M.dense_grid(spark, 256), x, 256)


@query(f"WITH {D.INCIDENCE}, {_XP}, y AS (SELECT B.i, sum(v * x) AS x FROM B JOIN X ON B.j = X.i GROUP BY B.i) SELECT o_orderkey AS i, coalesce(x, 0)::DOUBLE AS x FROM orders LEFT JOIN y ON i = o_orderkey")
def spmv_full(spark, d):
    n = D.n_parts(spark, d)
    rows = spark.read.parquet(f"{d}/orders.parquet").agg(F.max("o_orderkey") + 1).first()[0]
    a = M.SparseMatrix(D.incidence(spark, d), rows, n)
    return a.full(a.times(_x(spark, n)))


# Block vectors

_E = D.EMBEDDINGS


@query(f"WITH {_E}, Y AS (SELECT i, k, x FROM E WHERE k < 8) SELECT a.k AS p, b.k AS q, round(sum(a.x * b.x), 6) AS x FROM E a JOIN Y b ON a.i = b.i GROUP BY 1, 2")
def gram_xty(spark, d):
    e = D.embeddings(spark, d)
    return _rounded(M.gram(e, M.first_columns(e, 8)))


@query(f"WITH {_E} SELECT a.k AS p, b.k AS q, round(sum(a.x * b.x), 6) AS x FROM E a JOIN E b ON a.i = b.i GROUP BY 1, 2")
def gram_self(spark, d):
    g = M.gram_arrays(spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("x")), 64)
    return spark.createDataFrame([(p, q, float(g[p, q])) for p in range(64) for q in range(64)], "p int, q int, x double").withColumn("x", F.round("x", 6))


@query(f"WITH {_E} SELECT i, q::INTEGER AS k, round(sum(x * (((k * 3 + q * 5) % 7) - 3)), 6) AS x FROM E, range(0, 4) t(q) GROUP BY i, q")
def xy_small(spark, d):
    c = spark.range(64 * 4).select(F.expr("cast(id div 4 as int)").alias("p"), (F.col("id") % 4).cast("int").alias("q")).withColumn("c", ((F.col("p") * 3 + F.col("q") * 5) % 7 - 3).cast("double"))
    return _rounded(M.xy(D.embeddings(spark, d), c))


def _pair(spark, d):
    e = D.embeddings(spark, d)
    return e, e.withColumn("x", F.col("x") * F.col("x") + F.col("k"))


_P2 = f"WITH {_E}, Y AS (SELECT i, k, x * x + k AS x FROM E)"


@query(f"{_P2} SELECT E.i, E.k, round(E.x + Y.x, 6) AS x FROM E JOIN Y USING (i, k)")
def vec_add(spark, d):
    return _rounded(M.add(*_pair(spark, d)))


@query(f"{_P2} SELECT E.i, E.k, round(E.x - Y.x, 6) AS x FROM E JOIN Y USING (i, k)")
def vec_sub(spark, d):
    return _rounded(M.subtract(*_pair(spark, d)))


@query(f"{_P2} SELECT E.i, E.k, round(E.x * Y.x, 6) AS x FROM E JOIN Y USING (i, k)")
def hadamard(spark, d):
    return _rounded(M.hadamard(*_pair(spark, d)))


@query(f"WITH {_E} SELECT i, k, round(x * 0.25, 8) AS x FROM E")
def scale(spark, d):
    return _rounded(M.scale(D.embeddings(spark, d), 0.25), digits=8)


@query(f"WITH {_XP} SELECT sum(x * x * p_size) AS dot FROM X JOIN part ON i = p_partkey")
def dot(spark, d):
    x = _x(spark, D.n_parts(spark, d))
    y = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x"))
    return M.dot(x.withColumn("x", F.col("x") * F.col("x")), y)


@query(f"{_P2} SELECT E.k, round(sum(E.x * Y.x), 6) AS x FROM E JOIN Y USING (i, k) GROUP BY E.k")
def dot_cols(spark, d):
    return _rounded(M.dot_columns(*_pair(spark, d)))


@query(f"WITH {_E} SELECT k, round(sqrt(sum(x * x)), 6) AS norm FROM E GROUP BY k")
def col_norms(spark, d):
    return _rounded(M.column_norms(D.embeddings(spark, d)), "norm")


_ACTIVE = [k for k in range(64) if k % 3]
_NEW = "(k - 1 - k // 3)"


@query(f"WITH {_E} SELECT i, {_NEW}::INTEGER AS k, x FROM E WHERE k % 3 <> 0")
def gather_active(spark, d):
    return M.gather_active(D.embeddings(spark, d), _ACTIVE)


@query(f"WITH {_E} SELECT i, k, round(CASE WHEN k % 3 <> 0 THEN 2 * x ELSE x END, 6) AS x FROM E")
def scatter_active(spark, d):
    e = D.embeddings(spark, d)
    return _rounded(M.scatter_active(e, M.scale(M.gather_active(e, _ACTIVE), 2.0), _ACTIVE))


@query(f"WITH {_E}, n AS (SELECT k, sqrt(sum(x * x)) AS norm FROM E GROUP BY k) SELECT k, (norm > 3 AND k % 3 <> 0) AS active FROM n")
def active_mask(spark, d):
    return M.active_mask(M.column_norms(D.embeddings(spark, d)), [bool(k % 3) for k in range(64)], 3.0)


@query("SELECT i, k::INTEGER AS k, 0.5::DOUBLE AS x FROM range(0, (SELECT count(*) FROM part)) a(i), range(0, 3) b(k)")
def fill(spark, d):
    return M.filled(spark, spark.read.parquet(f"{d}/part.parquet").count(), 3, 0.5)


@query(_SQL["fill"].replace("0.5::DOUBLE", "((i * 7919 + k * 104729 + 12345) % 10007) / 10007.0::DOUBLE"))
def random_start(spark, d):
    return M.hashed_start(spark, spark.read.parquet(f"{d}/part.parquet").count(), 3)


@query("SELECT i, i AS j, 1.0::DOUBLE AS v FROM range(0, (SELECT count(*) FROM part)) t(i)")
def identity(spark, d):
    return M.identity(spark, spark.read.parquet(f"{d}/part.parquet").count())


@query("SELECT p_partkey AS i, p_partkey AS j, p_size::DOUBLE AS v FROM part")
def diag(spark, d):
    return M.diagonal(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("x")))


@query(f"WITH {D.TRADE} SELECT i, j, sum(v) AS v FROM (SELECT i, j, v / 2 AS v FROM M UNION ALL SELECT j, i, v / 2 FROM M) GROUP BY i, j")
def symmetrize(spark, d):
    return M.symmetrized(D.trade(spark, d))


# Layouts


@query(f"WITH {D.INCIDENCE} SELECT j AS i, i AS j, v FROM B")
def transpose(spark, d):
    return M.transpose(D.incidence(spark, d))


@query(f"WITH {D.TRADE}, T AS (SELECT i + 5 AS i, j + 7 AS j, v FROM M WHERE i < 4 AND j < 4) SELECT i, j, v FROM T UNION ALL SELECT i, j, v FROM M WHERE NOT EXISTS (SELECT 1 FROM T WHERE T.i = M.i AND T.j = M.j)")
def submatrix_copy(spark, d):
    m = D.trade(spark, d)
    return M.copy_into(m, m.where("i < 4 AND j < 4"), 5, 7)


@query(f"WITH {_E} SELECT i, k, x FROM E WHERE k < 10")
def eigvec_columns(spark, d):
    return M.first_columns(D.embeddings(spark, d), 10)


@query(f"WITH {D.COPURCHASE} SELECT i // 64 AS bi, j // 64 AS bj, count(*) AS nnz FROM A GROUP BY 1, 2")
def csb_blocks(spark, d):
    return M.block_counts(D.copurchase(spark, d), 64)


@query(f"WITH {D.COPURCHASE} SELECT i // 64 AS bi, count(*) AS nnz FROM A GROUP BY 1")
def block_row_nnz(spark, d):
    return M.block_row_counts(D.copurchase(spark, d), 64)


@query(f"WITH {D.COPURCHASE} SELECT (i // 32) // 4 AS wi, (j // 32) // 4 AS wj, i // 32 AS bi, j // 32 AS bj, count(*) AS nnz FROM A GROUP BY 1, 2, 3, 4")
def reblock(spark, d):
    a = D.cut(D.copurchase(spark, d))
    return M.reblock(M.block_counts(a, 128), 128, a, 32)


@query(f"WITH {D.COPURCHASE}, c AS (SELECT p_partkey AS i, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT i, count(*) AS n FROM A GROUP BY i) ON i = p_partkey) SELECT i, (sum(n) OVER (ORDER BY i) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY i))::BIGINT AS \"end\" FROM c")
def csr_rowptr(spark, d):
    return M.row_pointers(D.copurchase(spark, d), D.n_parts(spark, d))


@query(f"WITH {D.COPURCHASE}, s AS (SELECT ((SELECT max(p_partkey) FROM part) // 64 + 1) AS nb), q AS (SELECT nb // 6 AS e, nb % 6 AS m FROM s), g AS (SELECT DISTINCT i // 64 AS bi FROM A) SELECT bi, (CASE WHEN bi < (e + 1) * m THEN bi // (e + 1) ELSE m + (bi - (e + 1) * m) // greatest(e, 1) END)::BIGINT AS worker FROM g, q")
def row_block_map(spark, d):
    n = D.n_parts(spark, d)
    return M.block_row_workers(D.copurchase(spark, d), 64, n, 6)


@query(f"WITH {D.INCIDENCE} SELECT i, j, v FROM B WHERE i >= 100 AND i < 900")
def row_block_read(spark, d):
    return M.row_block(D.incidence(spark, d), 100, 900)


# Solvers


def _power_sql(steps: int) -> str:
    parts = [D.COPURCHASE, "x0 AS (SELECT i, 0.5::DOUBLE AS x FROM range(0, (SELECT max(p_partkey) + 1 FROM part)) t(i))"]
    for k in range(steps):
        parts.append(f"y{k} AS MATERIALIZED (SELECT A.i, sum(v * x) AS x FROM A JOIN x{k} ON A.j = x{k}.i GROUP BY A.i)")
        parts.append(f"n{k} AS MATERIALIZED (SELECT sqrt(sum(x * x)) AS n FROM y{k})")
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT i, x / n AS x FROM y{k}, n{k})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {k} AS iter, round(n, 6) AS norm FROM n{k}" for k in range(steps))


@query(_power_sql(10))
def power_norms(spark, d):
    return S.power_iteration(D.copurchase_matrix(spark, d), 10).withColumn("norm", F.round("norm", 6))


def _lanczos_sql(steps: int) -> str:
    n = "(SELECT max(p_partkey) + 1 FROM part)"
    parts = [D.COPURCHASE, f"q0 AS MATERIALIZED (SELECT i, 1 / sqrt({n}::DOUBLE) AS x FROM range(0, {n}) t(i))"]
    for k in range(steps):
        parts.append(f"z{k} AS MATERIALIZED (SELECT q.i, coalesce(y.x, 0)::DOUBLE AS x FROM q{k} q LEFT JOIN (SELECT A.i, sum(v * x) AS x FROM A JOIN q{k} ON A.j = q{k}.i GROUP BY A.i) y ON q.i = y.i)")
        for j in range(k + 1):
            parts.append(f"c{k}_{j} AS MATERIALIZED (SELECT sum(q{j}.x * z{k}.x) AS c FROM q{j} JOIN z{k} ON q{j}.i = z{k}.i)")
        minus = "".join(f" - q{j}.x * (SELECT c FROM c{k}_{j})" for j in range(k + 1))
        joins = "".join(f" JOIN q{j} ON q{j}.i = z{k}.i" for j in range(k + 1))
        parts.append(f"w{k} AS MATERIALIZED (SELECT z{k}.i, z{k}.x{minus} AS x FROM z{k}{joins})")
        parts.append(f"b{k} AS MATERIALIZED (SELECT sqrt(sum(x * x)) AS b FROM w{k})")
        parts.append(f"q{k + 1} AS MATERIALIZED (SELECT i, x / b AS x FROM w{k}, b{k})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {k} AS k, round((SELECT c FROM c{k}_{k}), 5) AS alpha, round((SELECT b FROM b{k}), 5) AS beta" for k in range(steps))


@query(_lanczos_sql(4))
def lanczos_alpha_beta(spark, d):
    a, b = S.lanczos_coefficients(D.copurchase_matrix(spark, d), 4)
    return spark.createDataFrame([(k, float(a[k]), float(b[k])) for k in range(len(a))], "k int, alpha double, beta double").select("k", F.round("alpha", 5).alias("alpha"), F.round("beta", 5).alias("beta"))


@query()
def lanczos_ritz(spark, d):
    return S.lanczos(D.copurchase_matrix(spark, d), 6).select("k", "ritz")


def _laplacian(spark, d):
    """D - W + I of the trade matrix made symmetric: positive definite."""
    w = M.symmetrized(D.trade(spark, d)).where("i <> j").withColumn("v", F.col("v") / 1000)
    deg = w.groupBy("i").agg((F.sum("v") + 1).alias("v")).select("i", F.col("i").alias("j"), "v")
    return M.SparseMatrix(D.cut(w.withColumn("v", -F.col("v")).unionByName(deg)), 25, 25)


@query()
def lobpcg_lambda(spark, d):
    return S.lobpcg(_laplacian(spark, d), b=3, iterations=6)


@query()
def lobpcg_residuals(spark, d):
    r = S.lobpcg_run(_laplacian(spark, d), b=3, iterations=6)[1]
    return spark.createDataFrame(r, "iter int, k int, norm double")


# Graphs

_LEVELS = "WITH RECURSIVE {g}, T(id, level) AS (SELECT id, 0::DOUBLE FROM VX WHERE id NOT IN (SELECT {a} FROM G) UNION SELECT {a}, level + {s} FROM T JOIN G ON {b} = id)"


@query(f"WITH {D.SUPPLY}, d AS (SELECT id, (SELECT 0) AS z, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM VX LEFT JOIN (SELECT v, count(*) AS i FROM G GROUP BY v) ON v = id LEFT JOIN (SELECT u, count(*) AS o FROM G GROUP BY u) ON u = id) SELECT max(i)::BIGINT AS max_in, min(i)::BIGINT AS min_in, round(avg(i), 6) AS avg_in, max(o)::BIGINT AS max_out, min(o)::BIGINT AS min_out, round(avg(o), 6) AS avg_out FROM d")
def degree_stats(spark, d):
    s = G.degree_stats(*D.supply_graph(spark, d))
    return s.withColumn("avg_in", F.round("avg_in", 6)).withColumn("avg_out", F.round("avg_out", 6))


@query("SELECT min(event_id) AS id FROM events GROUP BY user_id")
def sources(spark, d):
    return G.sources(*D.user_chains(spark, d))


@query("SELECT max(event_id) AS id FROM events GROUP BY user_id")
def sinks(spark, d):
    return G.sinks(*D.user_chains(spark, d))


@query(_LEVELS.format(g=D.SUPPLY, a="v", b="u", s="1") + " SELECT id, max(level) AS level FROM T GROUP BY id")
def toplevels(spark, d):
    return G.top_levels(*D.supply_graph(spark, d))


@query(_LEVELS.format(g=D.SUPPLY, a="u", b="v", s="1") + " SELECT id, max(level) AS level FROM T GROUP BY id")
def bottomlevels(spark, d):
    return G.bottom_levels(*D.supply_graph(spark, d))


@query(_LEVELS.format(g=D.SUPPLY, a="v", b="u", s="w") + " SELECT id, max(level) AS level FROM T GROUP BY id")
def weighted_toplevels(spark, d):
    return G.top_levels(*D.supply_graph(spark, d), step="w")


@query(_LEVELS.format(g=D.SUPPLY, a="v", b="u", s="1") + ", L AS (SELECT id, max(level) AS level FROM T GROUP BY id) SELECT id, level, (row_number() OVER (PARTITION BY level ORDER BY id))::INTEGER AS place FROM L")
def kahn_order(spark, d):
    return G.topological_order(*D.supply_graph(spark, d))


@query(f"WITH RECURSIVE {D.SUPPLY}, T(id, dist) AS (SELECT 0::BIGINT, 0 UNION SELECT v, dist + 1 FROM T JOIN G ON u = id) SELECT id, min(dist) AS dist FROM T GROUP BY id")
def bfs_dist(spark, d):
    e, _ = D.supply_graph(spark, d)
    return G.distances(e, spark.createDataFrame([(0,)], "id long"))


@query(_SQL["bfs_dist"].replace("SELECT id, min(dist) AS dist FROM T GROUP BY id", ", m AS (SELECT id, min(dist) AS dist FROM T GROUP BY id) SELECT id, dist FROM m ORDER BY dist DESC, id LIMIT 1").replace(") , m AS", "), m AS"))
def farthest(spark, d):
    e, _ = D.supply_graph(spark, d)
    return G.farthest(e, spark.createDataFrame([(0,)], "id long"))


@query("SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id) AS component FROM events")
def components(spark, d):
    return G.connected_components(*D.user_chains(spark, d))


@query("SELECT true AS acyclic")
def is_acyclic(spark, d):
    return G.is_acyclic(*D.supply_graph(spark, d))


# Every path between the ends of a shortcut has two edges: shortcuts skip one layer.
@query(f"WITH {D.CATALOGUE}, o AS (SELECT u, v FROM C WHERE v % 8 - u % 8 = 2), r AS (SELECT DISTINCT o.u, o.v FROM o JOIN C b ON b.v = o.v WHERE EXISTS (SELECT 1 FROM C a WHERE a.u = o.u AND a.v = b.u)) SELECT u, v, 1.0::DOUBLE AS w FROM C WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = C.u AND r.v = C.v)")
def transitive_reduction(spark, d):
    return G.transitive_reduction(D.catalogue_graph(spark, d))


_CUTS = f"WITH {D.SUPPLY}, {D.HALVES}, L AS (SELECT G.*, p.part AS pu, q.part AS pv FROM G JOIN P p ON u = p.id JOIN P q ON v = q.id)"


def _parted(spark, d):
    e, v = D.supply_graph(spark, d)
    return e, v, D.halves(v, 4)


@query(f"{_CUTS} SELECT pu, pv, count(*) AS n_edges, sum(w) AS w FROM L GROUP BY 1, 2")
def quotient(spark, d):
    e, _, p = _parted(spark, d)
    return G.quotient(e, p)


@query("SELECT true AS acyclic")
def partition_acyclic(spark, d):
    e, _, p = _parted(spark, d)
    return G.partition_is_acyclic(e, p)


@query(f"{_CUTS} SELECT sum(w) AS edge_cut, count(*) AS cut_edges FROM L WHERE pu <> pv")
def edge_cut(spark, d):
    e, _, p = _parted(spark, d)
    return P.edge_cut(e, p)


@query(f"{_CUTS} SELECT sum(w) AS comm_volume, count(*) AS messages FROM (SELECT arg_min(w, v) AS w FROM L WHERE pu <> pv GROUP BY u, pv)")
def comm_volume(spark, d):
    e, _, p = _parted(spark, d)
    return P.communication_volume(e, p)


@query(f"WITH RECURSIVE {D.SUPPLY}, {D.HALVES}, L AS (SELECT u, v, CASE WHEN p.part = q.part THEN 2 ELSE 12 END AS c FROM G JOIN P p ON u = p.id JOIN P q ON v = q.id), T(id, level) AS (SELECT id, 0::DOUBLE FROM VX WHERE id NOT IN (SELECT v FROM G) UNION SELECT v, level + c FROM T JOIN L ON u = id) SELECT max(level) AS latency FROM T")
def latency(spark, d):
    return P.latency(*_parted(spark, d))


@query(f"WITH {D.SUPPLY}, {D.HALVES} SELECT part, count(*)::DOUBLE AS w, count(*) AS n FROM P GROUP BY part")
def part_weights(spark, d):
    _, v, p = _parted(spark, d)
    return P.part_weights(v, p)


@query(f"WITH {D.SUPPLY}, {D.HALVES}, c AS (SELECT part, count(*)::DOUBLE AS w FROM P GROUP BY part) SELECT max(w) <= 1.1 * sum(w) / 4 AS balanced, round(max(w) * 4 / sum(w), 9) AS imbalance FROM c")
def balance_ok(spark, d):
    _, v, p = _parted(spark, d)
    return P.is_balanced(v, p, 4, 1.1).withColumn("imbalance", F.round("imbalance", 9))


@query("SELECT part, sum(b)::DOUBLE AS bytes FROM (SELECT o_custkey % 8 AS part, l_partkey, max(l_quantity) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY part")
def task_memory(spark, d):
    tasks = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 8).alias("part"))
    memory = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("name"), F.col("l_quantity").alias("bytes"))
    return P.task_memory(tasks, memory)


@query(f"WITH {D.SUPPLY}, s AS (SELECT u, v, w FROM G UNION ALL SELECT -1, id, 0 FROM VX WHERE id NOT IN (SELECT v FROM G) UNION ALL SELECT id, -2, 0 FROM VX WHERE id NOT IN (SELECT u FROM G)) SELECT count(*) AS n_edges, sum(w) AS w, count(DISTINCT u) AS n_u, count(DISTINCT v) AS n_v FROM s")
def single_ends(spark, d):
    e, _ = G.with_single_ends(*D.supply_graph(spark, d), -1, -2)
    return e.agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("w"), F.countDistinct("u").alias("n_u"), F.countDistinct("v").alias("n_v"))


@query(f"WITH {D.SUPPLY} SELECT v AS u, u AS v, w FROM G")
def reverse_graph(spark, d):
    return G.reverse(D.supply_graph(spark, d)[0])


@query(f"WITH {D.TRADE}, b AS (SELECT i AS u, j AS v, v AS w FROM M UNION ALL SELECT j, i, v FROM M), t AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS r FROM b) WHERE r = 1) SELECT a.u, a.v FROM t a JOIN t b ON a.u = b.v AND a.v = b.u WHERE a.u < a.v")
def mutual_best(spark, d):
    return P.mutual_best(D.trade(spark, d).select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("v").alias("w")))


@query(_LEVELS.format(g=f"{D.SUPPLY}, {D.HALVES}", a="v", b="u", s="1") + ", L AS (SELECT id, max(level) AS level FROM T GROUP BY id), Q AS (SELECT DISTINCT p.part AS u, q.part AS v FROM G JOIN P p ON G.u = p.id JOIN P q ON G.v = q.id WHERE p.part <> q.part), R(part, l) AS (SELECT DISTINCT part, 0::DOUBLE FROM P WHERE part NOT IN (SELECT v FROM Q) UNION SELECT v, l + 1 FROM R JOIN Q ON part = u) SELECT L.id, P.part, m.part_level, L.level FROM L JOIN P ON L.id = P.id JOIN (SELECT part, max(l) AS part_level FROM R GROUP BY part) m ON m.part = P.part")
def order_by_part(spark, d):
    return P.order_by_part(*_parted(spark, d))


@query(f"{_CUTS} SELECT id, part FROM P WHERE id NOT IN (SELECT v FROM L WHERE pu = pv)")
def part_sources(spark, d):
    return G.part_sources(*_parted(spark, d))


@query(_LEVELS.format(g=D.SUPPLY, a="v", b="u", s="1") + ", L AS (SELECT id, max(level) AS level FROM T GROUP BY id) SELECT id, level, (row_number() OVER (PARTITION BY level ORDER BY (id * 7) % 11 DESC, id))::INTEGER AS place FROM L")
def priority_order(spark, d):
    e, v = D.supply_graph(spark, d)
    return G.topological_order(e, v.withColumn("w", (F.col("id") * 7 % 11).cast("double")), "priority")


@query(f"WITH {D.SUPPLY} SELECT u, v, round(w * (2.0::DOUBLE * (SELECT count(*) FROM VX) / (SELECT sum(w) FROM G)), 8) AS w FROM G")
def scaled_to_ratio(spark, d):
    return _rounded(G.scaled_to_ratio(*D.supply_graph(spark, d), 2.0), "w", 8)


@query(f"WITH {D.TRADE} SELECT i AS u, string_agg(j::VARCHAR, ',' ORDER BY j) AS vs FROM M GROUP BY i")
def top_neighbours(spark, d):
    n = P.top_neighbours(D.trade(spark, d).select(F.col("i").alias("u"), F.col("j").alias("v")))
    return n.select("u", F.array_join(F.transform("vs", lambda x: x.cast("string")), ",").alias("vs"))


def _parity(spark, d):
    e, v = D.user_chains(spark, d)
    return D.cut(e), v.select("id", (F.col("id") % 2).cast("int").alias("part"))


@query("SELECT event_id AS id, (max(event_id % 2) OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS part FROM events")
def fix_acyclicity(spark, d):
    return P.fix_acyclicity(*_parity(spark, d))


@query("SELECT event_id AS id, (min(event_id % 2) OVER (PARTITION BY user_id ORDER BY event_id DESC))::INTEGER AS part FROM events")
def fix_acyclicity_up(spark, d):
    return P.fix_acyclicity(*_parity(spark, d), up=True)


@query("SELECT l_orderkey * 8 + l_linenumber AS id, (o_custkey % 4)::INTEGER AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def refine_blocks(spark, d):
    fine = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("parent"))
    coarse = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).cast("int").alias("part"))
    return P.refine_blocks(fine, coarse)


@query("SELECT count(*) = 0 AS acyclic FROM (SELECT user_id FROM events WHERE user_id % 7 = 0 GROUP BY user_id HAVING count(*) > 1)")
def is_acyclic_with_loops(spark, d):
    e, v = D.user_chains(spark, d)
    ends = spark.read.parquet(f"{d}/events.parquet").where("user_id % 7 = 0").groupBy("user_id").agg(F.max("event_id").alias("u"), F.min("event_id").alias("v")).where("u <> v")
    return G.is_acyclic(e.union(ends.select("u", "v", F.lit(1.0))), v)


@query(f"WITH {D.SUPPLY} SELECT count(*) AS n, 4::BIGINT AS parts, true AS balanced, true AS acyclic FROM VX")
def multilevel_properties(spark, d):
    e, v = D.supply_graph(spark, d)
    p = D.cut(P.acyclic_partition(e, v, 4))
    whole = p.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"))
    balanced, acyclic = P.is_balanced(v, p, 4, 1.25).first().balanced, G.partition_is_acyclic(e, p).first().acyclic
    return whole.withColumns({"balanced": F.lit(balanced), "acyclic": F.lit(acyclic)})


def _path(spark, n: int) -> M.SparseMatrix:
    """2 on the diagonal, -1 beside it: its eigenvalues are 2 - 2 cos(k pi / (n + 1))."""
    i = spark.range(n).select(F.col("id").alias("i"))
    d = i.select("i", F.col("i").alias("j"), F.lit(2.0).alias("v"))
    o = i.where(f"i < {n - 1}").select("i", (F.col("i") + 1).alias("j"), F.lit(-1.0).alias("v"))
    return M.SparseMatrix(D.cut(d.union(o).union(M.transpose(o))), n, n)


# From a constant start, half of the steps reach all eigenvectors that are even about the middle.
@query("SELECT k, round(2 - 2 * cos((2 * k + 1) * pi() / (n + 1)), 6) AS ritz FROM (SELECT (count(*) // 5 * 4)::BIGINT AS n FROM region), range(0, 2) t(k)")
def lanczos_path(spark, d):
    n = spark.read.parquet(f"{d}/region.parquet").count() // 5 * 4
    return _rounded(S.lanczos(_path(spark, n), n // 2).select(F.col("k").cast("long").alias("k"), "ritz"), "ritz")


@query("SELECT k, round(2 - 2 * cos((k + 1) * pi() / (n + 1)), 4) AS lambda FROM (SELECT count(*) AS n FROM nation), range(0, 3) t(k)")
def lobpcg_path(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").count()
    rows = S.lobpcg_run(_path(spark, n), b=3, iterations=16)[0]
    last = max(r[0] for r in rows)
    return spark.createDataFrame([(int(r[1]), round(float(r[2]), 4)) for r in rows if r[0] == last], "k long, lambda double")


@query("SELECT p_partkey AS id, p_retailprice AS w FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def heaviest(spark, d):
    return P.heaviest(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("w")), 20)


@query()
def multilevel_parts(spark, d):
    e, v = D.supply_graph(spark, d)
    return P.acyclic_partition(e, v, 4)
