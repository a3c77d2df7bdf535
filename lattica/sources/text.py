"""Text formats: Matrix Market, graph files, partitions, task tables, result lines.

Readers are text scans with built-in functions. Formats whose meaning hangs on
the place of a token in the file number their tokens by line.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix_market(spark: SparkSession, path: str, base: int = 1) -> tuple[DataFrame, int, int, str]:
    """((i, j, v), rows, cols, symmetry) of a coordinate file; patterns have v = 1, complex files their real part."""
    lines = spark.read.text(path)
    banner = (lines.where(F.col("value").startswith("%%MatrixMarket")).first() or [""])[0].lower().split()
    symmetry = {"symmetric": "lower", "general": "general"}.get(banner[4] if len(banner) > 4 else "general", "general")
    pattern = len(banner) > 3 and banner[3] == "pattern"
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("t"))
    # The size line is the first of the body; files are read from their start.
    size = body.first()[0]
    rows, cols, nnz = (int(x) for x in size[:3])
    value = F.lit(1.0) if pattern else F.coalesce(F.get("t", F.lit(2)).cast("double"), F.lit(1.0))
    width = 2 if pattern else 3
    entries = body.withColumn("__n", F.monotonically_increasing_id()).where("__n > 0").where(F.size("t") >= width)
    a = entries.select((F.get("t", F.lit(0)).cast("long") - base).alias("i"), (F.get("t", F.lit(1)).cast("long") - base).alias("j"), value.alias("v"))
    return a, rows, cols, symmetry


def write_matrix_market(a: DataFrame, path: str, rows: int, cols: int, symmetry: str = "general") -> None:
    """A folder of part files; the first holds banner and size."""
    spark, n = a.sparkSession, a.count()
    head = spark.createDataFrame([(0, 0, 0, f"%%MatrixMarket matrix coordinate real {symmetry}"), (1, 0, 0, f"{rows} {cols} {n}")], "k int, i long, j long, value string")
    body = a.select(F.lit(2).alias("k"), "i", "j", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    head.unionByName(body).orderBy("k", "j", "i").select("value").write.mode("overwrite").text(path)


def _unit(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.lit(1.0).alias("w"))


def read_dg(spark: SparkSession, path: str) -> DataFrame:
    """Edges of an in-neighbour file: nV, nE, starts of vertices 1 .. nV + 1, then the ids; weights 1, 0-based."""
    numbered = spark.read.text(path, wholetext=True).select(F.posexplode(F.array_remove(F.split("value", r"\s+"), "")).alias("k", "x")).select("k", F.col("x").cast("long").alias("x"))
    n = numbered.where("k = 0").first()[1]
    start = numbered.where((F.col("k") >= 2) & (F.col("k") < 3 + n)).select((F.col("k") - 2).alias("v"), "x")
    nxt = start.select((F.col("v") - 1).alias("v"), F.col("x").alias("to"))
    spans = start.join(nxt, "v").select("v", F.explode(F.when(F.col("to") > F.col("x"), F.sequence(F.col("x"), F.col("to") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("p"))
    first = start.agg(F.min("x")).first()[0]
    ids = numbered.where(F.col("k") >= 3 + n).select((F.col("k") - 3 - n + first).alias("p"), F.col("x").alias("u"))
    return spans.join(ids, "p").select((F.col("u") - 1).alias("u"), "v", F.lit(1.0).alias("w"))


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    """Edges of ``a -> b`` lines; a weight attribute is used where there is one."""
    lines = spark.read.text(path)
    pattern = r'^\s*"?(\d+)"?\s*->\s*"?(\d+)"?'
    e = lines.where(F.col("value").rlike(pattern))
    weight = F.regexp_extract("value", r"weight\s*=\s*\"?([0-9.]+)", 1)
    return e.select(F.regexp_extract("value", pattern, 1).cast("long").alias("u"), F.regexp_extract("value", pattern, 2).cast("long").alias("v"), F.coalesce(F.try_to_number(F.nullif(weight, F.lit("")), F.lit("999999999.999999")).cast("double"), F.lit(1.0)).alias("w"))


def read_fab(spark: SparkSession, path: str) -> DataFrame:
    """Edges of ``node: neighbours`` lines; a # ends a line."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "#.*$", "").alias("value")).where(F.col("value").contains(":"))
    node = F.trim(F.split("value", ":")[0])
    return _unit(lines.select(node.alias("u"), F.explode(F.array_remove(F.split(F.split("value", ":")[1], r"[\s,]+"), "")).alias("v")))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges (u, v, w) by the file's extension; Parquet holds a graph that was written before."""
    kind = re.search(r"\.(\w+)/?$", path)
    kind = kind[1].lower() if kind else ""
    if kind == "mtx":
        a, rows, cols, _ = read_matrix_market(spark, path)
        if rows != cols:
            raise ValueError(f"{path}: {rows} x {cols} isn't square")
        return a.select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("v").alias("w"))
    readers = {"dg": read_dg, "dgraph": read_dg, "dot": read_dot, "fab": read_fab, "parquet": lambda s, p: s.read.parquet(p), "bin": lambda s, p: s.read.parquet(p)}
    if kind not in readers:
        raise ValueError(f"{path}: no reader for .{kind}")
    return readers[kind](spark, path)


def write_graph(edges: DataFrame, path: str) -> None:
    """Parquet for .parquet and .bin, DOT for .dot."""
    if path.endswith(".dot"):
        body = edges.select(F.lit(1).alias("k"), "u", "v", F.format_string("%d -> %d [weight=%s];", "u", "v", F.col("w").cast("string")).alias("value"))
        ends = edges.sparkSession.createDataFrame([(0, "digraph G {"), (2, "}")], "k int, value string").select("k", F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), "value")
        body.unionByName(ends).orderBy("k", "u", "v").select("value").write.mode("overwrite").text(path)
    else:
        edges.write.mode("overwrite").parquet(path)


def write_parts(parts: DataFrame, path: str) -> None:
    """One part number a line, by vertex id."""
    parts.orderBy("id").select(F.col("part").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=False).withColumn("k", F.monotonically_increasing_id())
    from pyspark.sql import Window

    return lines.select((F.row_number().over(Window.orderBy("k")) - 1).cast("long").alias("id"), F.col("value").cast("int").alias("part"))


def read_boundaries(spark: SparkSession, path: str) -> list[int]:
    """Count, then boundaries between the parts of a task list."""
    words = [int(x) for r in spark.read.text(path).toLocalIterator() for x in r[0].split()]
    if not words or len(words) - 1 < words[0]:
        raise ValueError(f"{path}: fewer boundaries than announced")
    return words[1 : 1 + words[0]]


def write_boundaries(spark: SparkSession, bounds: list[int], path: str) -> None:
    spark.createDataFrame([("\n".join(map(str, [len(bounds), *bounds])),)], "value string").coalesce(1).write.mode("overwrite").text(path)


TASKS = "pos long, op int, nums array<int>, strs array<string>, task_id int, part int, priority int"


def write_tasks(tasks: DataFrame, path: str) -> None:
    """A count, then ``op,#num,num...,#str,str...,task_id,part,priority`` a line, by pos."""
    spark, n = tasks.sparkSession, tasks.count()
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    cells = F.flatten(F.array(F.array(F.col("op").cast("string"), F.size("nums").cast("string")), text("nums"), F.array(F.size("strs").cast("string")), F.col("strs"), F.array(*[F.col(c).cast("string") for c in ("task_id", "part", "priority")])))
    rows = tasks.select("pos", F.array_join(cells, ",").alias("value"))
    spark.createDataFrame([(-1, str(n))], "pos long, value string").unionByName(rows).orderBy("pos").select("value").write.mode("overwrite").text(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(pos, op, nums, strs, task_id, part, priority); pos by the order of the lines."""
    from pyspark.sql import Window

    lines = spark.read.text(path).withColumn("k", F.monotonically_increasing_id()).where(F.col("value").contains(","))
    t = lines.select((F.row_number().over(Window.orderBy("k")) - 1).cast("long").alias("pos"), F.split("value", ",").alias("t"))
    n = F.get("t", F.lit(1)).cast("int")
    s = F.get("t", n + 2).cast("int")
    end = n + 3 + s
    return t.select("pos", F.get("t", F.lit(0)).cast("int").alias("op"), F.transform(F.slice("t", F.lit(3), n), lambda x: x.cast("int")).alias("nums"), F.slice("t", n + 4, s).alias("strs"), *[F.get("t", end + k).cast("int").alias(c) for k, c in enumerate(("task_id", "part", "priority"))])


def result_lines(values: list[float], seconds: list[float]) -> list[str]:
    """Seconds of each iteration and their mean, then the values, four decimals each."""
    mean = sum(seconds) / max(len(seconds), 1)
    return [",".join(f"{x:.4f}" for x in [*seconds, mean]), ",".join(f"{x:.4f}" for x in values)]
