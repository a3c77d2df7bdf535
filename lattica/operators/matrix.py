"""Sparse matrices as (i, j, v) tables: products, layouts, element-wise kernels.

A vector is (i, x), a block vector (i, k, x) in long form. Indices are 0-based
longs. Products are an equi-join and a sum with partial sums before the shuffle;
a vector is broadcast only if its length is proven to be small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a vector up to which it is broadcast (two numbers each).
BROADCAST_ROWS = 500_000


@dataclass
class SparseMatrix:
    """Coordinate table with its shape. ``symmetry`` says which triangle is stored."""

    coo: DataFrame
    n_rows: int
    n_cols: int
    symmetry: str = "general"

    def general(self) -> SparseMatrix:
        """All entries stored; a triangle is mirrored."""
        if self.symmetry == "general":
            return self
        mirrored = self.coo.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        return SparseMatrix(self.coo.unionByName(mirrored), self.n_rows, self.n_cols)

    def transpose(self) -> SparseMatrix:
        return SparseMatrix(transpose(self.coo), self.n_cols, self.n_rows, {"lower": "upper", "upper": "lower"}.get(self.symmetry, self.symmetry))

    def times(self, x: DataFrame) -> DataFrame:
        return spmv(self.general().coo, x, x_rows=self.n_cols)

    def full(self, y: DataFrame) -> DataFrame:
        """``y`` with a 0 for each row of the matrix that has no entry."""
        return fill_missing(y, self.n_rows)


def _side(x: DataFrame, rows: int | None, width: int = 1) -> DataFrame:
    return F.broadcast(x) if rows is not None and rows * width <= BROADCAST_ROWS else x


def spmv(a: DataFrame, x: DataFrame, x_rows: int | None = None) -> DataFrame:
    """y = A x: (i, x). Rows without an entry are absent, see fill_missing()."""
    v = _side(x.select(F.col("i").alias("j"), F.col("x").alias("__x")), x_rows)
    return a.join(v, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("__x")).alias("x"))


def spmm(a: DataFrame, x: DataFrame, x_rows: int | None = None, width: int = 1) -> DataFrame:
    """Y = A X for a block vector in long form: (i, k, x)."""
    v = _side(x.select(F.col("i").alias("j"), "k", F.col("x").alias("__x")), x_rows, width)
    return a.join(v, "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("__x")).alias("x"))


def spmm_arrays(a: DataFrame, x: DataFrame, width: int, x_rows: int | None = None) -> DataFrame:
    """Y = A X for (i, x array): one sum per column, so one row per entry is joined."""
    v = _side(x.select(F.col("i").alias("j"), F.col("x").alias("__x")), x_rows, width)
    sums = [F.sum(F.col("v") * F.col("__x")[k]).alias(f"__{k}") for k in range(width)]
    return a.join(v, "j").groupBy("i").agg(*sums).select("i", F.array(*[f"__{k}" for k in range(width)]).alias("x"))


def fill_missing(y: DataFrame, n: int) -> DataFrame:
    rows = y.sparkSession.range(n).select(F.col("id").alias("i"))
    return rows.join(y, "i", "left").select("i", F.coalesce("x", F.lit(0.0)).alias("x"))


# Layouts


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def to_blocks(a: DataFrame, width: int) -> DataFrame:
    """Blocks (bi, bj, nnz, rloc, cloc, val); empty blocks are absent.

    A block holds width x width entries at most, which bounds the lists.
    """
    b = a.select(F.expr(f"i div {width}").alias("bi"), F.expr(f"j div {width}").alias("bj"), F.struct((F.col("i") % width).cast("int").alias("r"), (F.col("j") % width).cast("int").alias("c"), "v").alias("e"))
    b = b.groupBy("bi", "bj").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return b.select("bi", "bj", F.size("e").cast("long").alias("nnz"), F.col("e.r").alias("rloc"), F.col("e.c").alias("cloc"), F.col("e.v").alias("val"))


def from_blocks(blocks: DataFrame, width: int) -> DataFrame:
    e = blocks.select("bi", "bj", F.explode(F.arrays_zip("rloc", "cloc", "val")).alias("e"))
    return e.select((F.col("bi") * width + F.col("e.rloc")).alias("i"), (F.col("bj") * width + F.col("e.cloc")).alias("j"), F.col("e.val").alias("v"))


def block_counts(a: DataFrame, width: int) -> DataFrame:
    return a.groupBy(F.expr(f"i div {width}").alias("bi"), F.expr(f"j div {width}").alias("bj")).agg(F.count(F.lit(1)).alias("nnz"))


def block_row_counts(a: DataFrame, width: int) -> DataFrame:
    return a.groupBy(F.expr(f"i div {width}").alias("bi")).agg(F.count(F.lit(1)).alias("nnz"))


def reblock(counts: DataFrame, width: int, finer: DataFrame | None = None, narrow: int | None = None) -> DataFrame:
    """Counts of narrower blocks, each with the wide block it lies in."""
    c = block_counts(finer, narrow)
    ratio = width // narrow
    wide = c.select("*", F.expr(f"bi div {ratio}").alias("wi"), F.expr(f"bj div {ratio}").alias("wj"))
    return wide.join(counts.select(F.col("bi").alias("wi"), F.col("bj").alias("wj")), ["wi", "wj"], "left_semi").select("wi", "wj", "bi", "bj", "nnz")


def row_pointers(a: DataFrame, n: int) -> DataFrame:
    """(i, start, end) of the CSR form; the running sum is taken in two steps.

    Rows are cut into ranges, whose totals are few, so no task orders all rows.
    """
    from pyspark.sql import Window

    step = 1 << 16
    c = a.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    rows = a.sparkSession.range(n).select(F.col("id").alias("i")).join(c, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"), F.expr(f"i div {step}").alias("g"))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("g").agg(F.sum("n").alias("t")).select("g", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("g").orderBy("i")
    return rows.withColumn("upto", F.sum("n").over(inside)).join(base, "g").select("i", (F.col("base") + F.col("upto") - F.col("n")).alias("start"), (F.col("base") + F.col("upto")).alias("end"))


def block_row_workers(a: DataFrame, width: int, n: int, workers: int) -> DataFrame:
    """(bi, worker): block rows spread evenly and in order."""
    blocks = -(-n // width)
    each, more = divmod(blocks, workers)
    bi = F.col("bi")
    worker = F.when(bi < (each + 1) * more, F.expr(f"bi div {each + 1}")).otherwise(more + F.expr(f"(bi - {(each + 1) * more}) div {max(each, 1)}"))
    return a.select(F.expr(f"i div {width}").alias("bi")).distinct().select("bi", worker.cast("long").alias("worker"))


def row_block(a: DataFrame, first: int, last: int) -> DataFrame:
    """Rows first .. last-1; a range predicate that reaches the scan."""
    return a.where((F.col("i") >= first) & (F.col("i") < last))


def copy_into(target: DataFrame, part: DataFrame, r0: int, c0: int) -> DataFrame:
    """``part`` written over ``target`` at (r0, c0)."""
    moved = part.select((F.col("i") + r0).alias("i"), (F.col("j") + c0).alias("j"), "v")
    return target.join(moved, ["i", "j"], "left_anti").unionByName(moved)


def first_columns(x: DataFrame, b: int) -> DataFrame:
    return x.where(F.col("k") < b)


# Block vectors, long form (i, k, x)


def gram(x: DataFrame, y: DataFrame) -> DataFrame:
    """X'Y: (p, q, x)."""
    r = y.select("i", F.col("k").alias("q"), F.col("x").alias("__y"))
    return x.select("i", F.col("k").alias("p"), "x").join(r, "i").groupBy("p", "q").agg(F.sum(F.col("x") * F.col("__y")).alias("x"))


def gram_arrays(x: DataFrame, b: int, column: str = "x", other: str = "x"):
    """X'Y of array columns of one table as NumPy: b x b sums in one aggregate."""
    import numpy as np

    return np.array(_outer(x, [(column, b), (other, b)])[0][1])


def _outer(x: DataFrame, columns: list[tuple[str, int]]) -> list[list]:
    """All Gram blocks of array columns, by Pandas partials: few rows leave each partition."""
    from collections.abc import Iterator

    import numpy as np

    names, widths = [c for c, _ in columns], [w for _, w in columns]
    total = sum(widths)

    def part(batches) -> Iterator:
        import pyarrow as pa

        g = np.zeros((total, total))
        for b in batches:
            if b.num_rows:
                m = np.concatenate([b.column(n).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, w) for n, w in columns], axis=1)
                g += m.T @ m
        yield pa.RecordBatch.from_pydict({"p": pa.array(np.arange(total * total)), "x": pa.array(g.ravel())})

    rows = x.select(*dict.fromkeys(names)).mapInArrow(part, "p long, x double").groupBy("p").agg(F.sum("x").alias("x")).orderBy("p").collect()
    g = np.array([r.x for r in rows]).reshape(total, total) if rows else np.zeros((total, total))
    cuts = np.cumsum([0, *widths])
    return [[g[cuts[i] : cuts[i + 1], cuts[j] : cuts[j + 1]] for j in range(len(widths))] for i in range(len(widths))]


def xy(x: DataFrame, c: DataFrame) -> DataFrame:
    """X C with a small C (p, q, c), which is bounded by the block width squared."""
    m = F.broadcast(c.select(F.col("p").alias("k"), "q", "c"))
    return x.join(m, "k").groupBy("i", "q").agg(F.sum(F.col("x") * F.col("c")).alias("x")).select("i", F.col("q").alias("k"), "x")


def times_dense(column: str, c) -> Column:
    """Array column times a small NumPy matrix; map-only."""
    return F.array(*[sum((F.col(column)[p] * float(c[p, q]) for p in range(c.shape[0])), F.lit(0.0)) for q in range(c.shape[1])])


def _both(x: DataFrame, y: DataFrame, value: Column) -> DataFrame:
    return x.join(y.select("i", "k", F.col("x").alias("__y")), ["i", "k"]).select("i", "k", value.alias("x"))


def add(x: DataFrame, y: DataFrame) -> DataFrame:
    return _both(x, y, F.col("x") + F.col("__y"))


def subtract(x: DataFrame, y: DataFrame) -> DataFrame:
    """x - y; for the other direction swap the arguments."""
    return _both(x, y, F.col("x") - F.col("__y"))


def hadamard(x: DataFrame, y: DataFrame) -> DataFrame:
    return _both(x, y, F.col("x") * F.col("__y"))


def scale(x: DataFrame, factor: float) -> DataFrame:
    return x.withColumn("x", F.col("x") * factor)


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("i", F.col("x").alias("__y")), "i").agg(F.sum(F.col("x") * F.col("__y")).alias("dot"))


def dot_columns(x: DataFrame, y: DataFrame) -> DataFrame:
    return _both(x, y, F.col("x") * F.col("__y")).groupBy("k").agg(F.sum("x").alias("x"))


def column_norms(x: DataFrame) -> DataFrame:
    return x.groupBy("k").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))


def gather_active(x: DataFrame, active: list[int]) -> DataFrame:
    """The active columns, numbered anew in their order."""
    new = F.create_map(*[F.lit(v) for p, k in enumerate(active) for v in (k, p)])
    return x.where(F.col("k").isin(active)).select("i", new[F.col("k")].alias("k"), "x")


def scatter_active(x: DataFrame, part: DataFrame, active: list[int]) -> DataFrame:
    """``part``'s columns written back to the active columns of ``x``."""
    old = F.create_map(*[F.lit(v) for p, k in enumerate(active) for v in (p, k)])
    back = part.select("i", old[F.col("k")].alias("k"), F.col("x").alias("__y"))
    return x.join(back, ["i", "k"], "left").select("i", "k", F.coalesce("__y", "x").alias("x"))


def active_mask(norms: DataFrame, before: list[bool], tol: float) -> DataFrame:
    """(k, active): still active and above ``tol``; a column never comes back."""
    old = F.array(*[F.lit(b) for b in before])
    return norms.select("k", ((F.col("norm") > tol) & F.get(old, F.col("k"))).alias("active"))


def filled(spark, n: int, b: int, value: float) -> DataFrame:
    return spark.range(n * b).select(F.expr(f"id div {b}").alias("i"), (F.col("id") % b).cast("int").alias("k"), F.lit(value).alias("x"))


def hashed_start(spark, n: int, b: int) -> DataFrame:
    """Reproducible start block in [0, 1): ((i * 7919 + k * 104729 + 12345) mod 10007) / 10007."""
    h = (F.col("i") * 7919 + F.col("k") * 104729 + 12345) % 10007
    return filled(spark, n, b, 0.0).withColumn("x", h / 10007.0)


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def diagonal(x: DataFrame) -> DataFrame:
    return x.select("i", F.col("i").alias("j"), F.col("x").alias("v"))


def symmetrized(a: DataFrame) -> DataFrame:
    both = a.select("i", "j", (F.col("v") / 2).alias("v")).unionByName(transpose(a).select("i", "j", (F.col("v") / 2).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def dense_grid(spark, n: int) -> DataFrame:
    """A[x, y] = 10 x + y, every entry stored."""
    return spark.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j")).withColumn("v", (10 * F.col("i") + F.col("j")).cast("double"))
