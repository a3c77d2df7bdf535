"""Cutting lineage in iterative plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattica-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that a step doesn't carry all before it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in the checkpoint folder, until erase(); its shuffle files go at once."""
    spark, free = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex[:12]}"
    was = spark.conf.get(free, None)
    spark.conf.set(free, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(free) if was is None else spark.conf.set(free, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def erase(table: DataFrame) -> None:
    """Deletes a table of written()."""
    spark = table.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written_at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
