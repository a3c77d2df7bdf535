"""Binary sparse-matrix files as a Spark data source, read in ranges of entries.

Formats (little-endian):
    csc   int32 rows, cols, nnz; int32 colptr[cols + 1]; int32 row[nnz]; float32 value[nnz]; 1-based
    csr   int32 rows, cols, nnz; int32 rowptr[rows + 1]; int32 or float64 col[nnz]; float64 value[nnz]

A partition reads the pointers and its own range of indices and values, so no
task holds more than ``entries`` of them. Counts may exceed 2^31 (read as unsigned).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "i long, j long, v double"


class Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class MatrixFile(DataSource):
    """Options: path, layout (csc, csr), base (1, 0), index (int32, float64), entries, first_row, last_row."""

    @classmethod
    def name(cls) -> str:
        return "lattica_matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(dict(self.options))


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.csc = options.get("layout", "csc") == "csc"
        self.base = int(options.get("base", "1"))
        self.index = np.dtype("<f8" if options.get("index") == "float64" else "<i4")
        self.value = np.dtype("<f4" if self.csc else "<f8")
        self.entries = int(options.get("entries", str(4 << 20)))
        self.rows = (int(options.get("first_row", "0")), int(options.get("last_row", str(1 << 62))))

    def _open(self):
        from pyarrow import fs

        if "://" in self.path:
            system, path = fs.FileSystem.from_uri(self.path)
        else:
            system, path = fs.LocalFileSystem(), self.path.removeprefix("file:")
        return system.open_input_file(path)

    def _header(self, f) -> tuple[int, int, int]:
        return tuple(int(x) for x in np.frombuffer(f.read_at(12, 0), "<u4"))

    def partitions(self) -> list[Range]:
        with self._open() as f:
            nnz = self._header(f)[2]
        return [Range(a, min(a + self.entries, nnz)) for a in range(0, nnz, self.entries)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator:
        import pyarrow as pa

        if part.last == part.first:
            return
        with self._open() as f:
            rows, cols, nnz = self._header(f)
            n = (cols if self.csc else rows) + 1
            ptr = np.frombuffer(f.read_at(4 * n, 12), "<u4").astype(np.int64)
            ptr = ptr - ptr[0]
            at = 12 + 4 * n
            k = part.last - part.first
            other = np.frombuffer(f.read_at(self.index.itemsize * k, at + self.index.itemsize * part.first), self.index).astype(np.int64) - self.base
            value = np.frombuffer(f.read_at(self.value.itemsize * k, at + self.index.itemsize * nnz + self.value.itemsize * part.first), self.value).astype(np.float64)
        own = np.searchsorted(ptr, np.arange(part.first, part.last), "right") - 1
        i, j = (other, own) if self.csc else (own, other)
        if len(i) and (i.min() < 0 or j.min() < 0 or i.max() >= rows or j.max() >= cols):
            raise ValueError(f"{self.path}: an index lies outside of {rows} x {cols}")
        keep = (i >= self.rows[0]) & (i < self.rows[1])
        i, j, value = i[keep], j[keep], value[keep]
        for a in range(0, len(i), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (i, j, value)], names=["i", "j", "v"])


def read_matrix(spark: SparkSession, path: str, **options) -> DataFrame:
    """(i, j, v), 0-based; ``first_row`` and ``last_row`` read a block of rows only."""
    spark.dataSource.register(MatrixFile)
    return spark.read.format("lattica_matrix").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def read_header(path: str) -> tuple[int, int, int]:
    r = MatrixReader({"path": path})
    with r._open() as f:
        return r._header(f)


def write_matrix(a: DataFrame, path: str, n_rows: int, n_cols: int, layout: str = "csc", base: int = 1, index: str = "int32") -> None:
    """Writes one file through the driver, a batch at a time, in file order."""
    csc = layout == "csc"
    own, other = ("j", "i") if csc else ("i", "j")
    n = n_cols if csc else n_rows
    counts = np.zeros(n + 1, np.int64)
    for r in a.groupBy(own).count().toLocalIterator():
        counts[r[0] + 1] = r[1]
    ptr = np.cumsum(counts) + base
    with open(path, "wb") as f, open(path + ".values", "w+b") as g:
        np.array([n_rows, n_cols, counts.sum()], "<u4").tofile(f)
        ptr.astype("<u4").tofile(f)
        for r in a.orderBy(own, other).toLocalIterator():
            f.write(np.array([r[other] + base], "<f8" if index == "float64" else "<i4").tobytes())
            g.write(np.array([r["v"]], "<f4" if csc else "<f8").tobytes())
        g.seek(0)
        while block := g.read(1 << 20):
            f.write(block)
    import os

    os.remove(path + ".values")
