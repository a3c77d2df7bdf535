"""Streams give what the whole tables give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.streaming import edges as E


def drained(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_degrees(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 0), (0, 1)], "u long, v long")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = {tuple(r) for r in drained(spark, E.streaming_degrees(stream), "degrees", "complete").collect()}
    assert got == {tuple(r) for r in G.degrees(e, spark.range(3)).collect()}


def test_windows(spark, tmp_path):
    t = datetime(2024, 1, 1)
    ev = spark.createDataFrame([(t + timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(60)], "ts timestamp, event_type string, value double")
    ev.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e"))
    got = {tuple(r) for r in drained(spark, E.windowed_counts(stream), "windows", "update").collect()}
    want = ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select("w.start", "event_type", "n", "v")
    assert got == {tuple(r) for r in want.collect()}
