"""Matrices and graphs derived from the tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.storage import cut
from lattica.operators.matrix import SparseMatrix


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def n_parts(spark: SparkSession, d: str) -> int:
    return _t(spark, d, "part").agg(F.max("p_partkey") + 1).first()[0]


def copurchase(spark: SparkSession, d: str) -> DataFrame:
    """A[i, j]: orders that hold both parts. An order has few lines, so the join stays narrow."""
    b = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("i")).distinct()
    pairs = b.join(b.withColumnRenamed("i", "j"), "o")
    return pairs.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))


COPURCHASE = """b AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
A AS MATERIALIZED (SELECT x.p AS i, y.p AS j, count(*)::DOUBLE AS v FROM b x JOIN b y ON x.o = y.o GROUP BY 1, 2)"""


def copurchase_matrix(spark: SparkSession, d: str) -> SparseMatrix:
    n = n_parts(spark, d)
    return SparseMatrix(copurchase(spark, d), n, n)


def incidence(spark: SparkSession, d: str) -> DataFrame:
    """B[order, part]: quantity."""
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


INCIDENCE = "B AS MATERIALIZED (SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def trade(spark: SparkSession, d: str) -> DataFrame:
    """M[supplier's nation, customer's nation]: quantity."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("j"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("i"))
    m = li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    return m.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.sum("l_quantity").alias("v"))


TRADE = """M AS MATERIALIZED (SELECT s_nationkey::BIGINT AS i, c_nationkey::BIGINT AS j, sum(l_quantity) AS v FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """(i, k, x) of the embedding vectors."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("k", "x"))
    return e.select("i", "k", F.col("x").cast("double").alias("x"))


EMBEDDINGS = "E AS MATERIALIZED (SELECT vec_id AS i, (k - 1)::INTEGER AS k, embedding[k]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"

# A layered supply graph: region, nation, supplier or customer, part, order.
# An id is the key times 8 plus the layer's number.
SUPPLY_LAYERS = """
SELECT n_regionkey::BIGINT * 8 AS u, n_nationkey::BIGINT * 8 + 1 AS v, 1.0::DOUBLE AS w FROM nation
UNION ALL SELECT s_nationkey::BIGINT * 8 + 1, s_suppkey * 8 + 2, 1.0::DOUBLE FROM supplier
UNION ALL SELECT l_suppkey * 8 + 2, l_partkey * 8 + 3, sum(l_quantity) FROM lineitem GROUP BY 1, 2
UNION ALL SELECT l_partkey * 8 + 3, l_orderkey * 8 + 4, sum(l_quantity) FROM lineitem GROUP BY 1, 2
UNION ALL SELECT c_nationkey::BIGINT * 8 + 1, c_custkey * 8 + 5, 1.0::DOUBLE FROM customer
UNION ALL SELECT o_custkey * 8 + 5, o_orderkey * 8 + 4, 1.0::DOUBLE FROM orders"""
SUPPLY = f"""G AS MATERIALIZED ({SUPPLY_LAYERS}), VX AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT u AS id FROM G UNION ALL SELECT v FROM G))"""


def _edges(e: DataFrame, u, v, w=None) -> DataFrame:
    return e.select(u.cast("long").alias("u"), v.cast("long").alias("v"), (w if w is not None else F.lit(1.0)).cast("double").alias("w"))


def supply_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    li = _t(spark, d, "lineitem")
    sp = li.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    po = li.groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("w"))
    e = (
        _edges(_t(spark, d, "nation"), c("n_regionkey") * 8, c("n_nationkey") * 8 + 1)
        .union(_edges(_t(spark, d, "supplier"), c("s_nationkey") * 8 + 1, c("s_suppkey") * 8 + 2))
        .union(_edges(sp, c("l_suppkey") * 8 + 2, c("l_partkey") * 8 + 3, c("w")))
        .union(_edges(po, c("l_partkey") * 8 + 3, c("l_orderkey") * 8 + 4, c("w")))
        .union(_edges(_t(spark, d, "customer"), c("c_nationkey") * 8 + 1, c("c_custkey") * 8 + 5))
        .union(_edges(_t(spark, d, "orders"), c("o_custkey") * 8 + 5, c("o_orderkey") * 8 + 4))
    )
    e = cut(e)
    v = e.select(F.col("u").alias("id")).union(e.select("v")).distinct().withColumn("w", F.lit(1.0))
    return e, v


def catalogue_graph(spark: SparkSession, d: str) -> DataFrame:
    """Region to nation to supplier to part, and shortcuts from region to supplier and nation to part."""
    c = F.col
    sp = _t(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), c("s_nationkey") == c("n_nationkey"))
    np = sp.join(s, c("l_suppkey") == c("s_suppkey")).select("s_nationkey", "l_partkey").distinct()
    return cut(
        _edges(_t(spark, d, "nation"), c("n_regionkey") * 8, c("n_nationkey") * 8 + 1)
        .union(_edges(s, c("s_nationkey") * 8 + 1, c("s_suppkey") * 8 + 2))
        .union(_edges(sp, c("l_suppkey") * 8 + 2, c("l_partkey") * 8 + 3))
        .union(_edges(s, c("n_regionkey") * 8, c("s_suppkey") * 8 + 2))
        .union(_edges(np, c("s_nationkey") * 8 + 1, c("l_partkey") * 8 + 3))
    )


CATALOGUE = """sp AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), sn AS (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey),
C AS MATERIALIZED (SELECT n_regionkey::BIGINT * 8 AS u, n_nationkey::BIGINT * 8 + 1 AS v FROM nation
UNION ALL SELECT s_nationkey::BIGINT * 8 + 1, s_suppkey * 8 + 2 FROM sn UNION ALL SELECT l_suppkey * 8 + 2, l_partkey * 8 + 3 FROM sp
UNION ALL SELECT n_regionkey::BIGINT * 8, s_suppkey * 8 + 2 FROM sn
UNION ALL SELECT DISTINCT s_nationkey::BIGINT * 8 + 1, l_partkey * 8 + 3 FROM sp JOIN sn ON l_suppkey = s_suppkey)"""


def user_chains(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each user's events as a chain by id."""
    ev = _t(spark, d, "events").select("event_id", "user_id")
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = ev.withColumn("v", nxt).where("v IS NOT NULL")
    return _edges(e, F.col("event_id"), F.col("v")), ev.select(F.col("event_id").alias("id"), F.lit(1.0).alias("w"))


def halves(vertices: DataFrame, k: int) -> DataFrame:
    """(id, part) by the id's layer (acyclic for the layered graphs): layers 0-2, then the rest."""
    return vertices.select("id", F.when(F.col("id") % 8 <= 1, 0).when((F.col("id") % 8).isin(2, 5), 1).when(F.col("id") % 8 == 3, 2).otherwise(3).alias("part")).withColumn("part", F.least(F.col("part"), F.lit(k - 1)))


HALVES = "P AS (SELECT id, CASE WHEN id % 8 <= 1 THEN 0 WHEN id % 8 IN (2, 5) THEN 1 WHEN id % 8 = 3 THEN 2 ELSE 3 END AS part FROM VX)"
