"""Helpers shared by the operators: word patterns, folds, shared storage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, VT, FF, CR.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the one that ``spark.checkpoint.dir`` names; where the session names
    none, a local temporary folder is set if the master is local, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str, free: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage, so that a lost executor costs a re-read and not the
    whole history. Files go when the application ends. ``free``: the shuffle
    files of this write go when it ends, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    was = spark.conf.get(CLEANUP, None)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if free:
            spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._written_at)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then
            return


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns that an operator is about to add."""
    return docs.drop(*[c for c in docs.columns if c in names])


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as ``__doc`` beside the columns an operator reads, so that no name clashes."""
    return docs.select(F.struct(*docs.columns).alias("__doc"), *columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batch, column: str, max_bytes: int = 4 << 20):
    """Slices of an Arrow batch whose texts hold about ``max_bytes`` at most.

    A single text beyond that makes a slice of its own, so texts stay whole.
    """
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def lower_words(texts, lower: bool = True):
    """Dictionary codes of all words of Arrow strings, row offsets, dictionary.

    Lower-cases A-Z only. Nulls count as empty.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    t = pc.fill_null(texts, "")
    if isinstance(t, pa.ChunkedArray):
        t = t.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(t) if lower else t)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    keep = pc.not_equal(flat, "")
    kept = keep.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(counts)), counts)[kept]
    d = flat.filter(keep).dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(counts)), out=offsets[1:])
    return d.indices.to_numpy(zero_copy_only=False), offsets, d.dictionary
