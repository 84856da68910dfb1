from pyspark.sql import functions as F

from rosterloom.streaming import changes

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_counts_equal_the_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    source = tmp_path / "in"
    batch.coalesce(1).write.parquet(str(source))
    stream = changes.seats(spark, str(source), ", ".join(f"{n} {t}" for n, t in batch.dtypes))
    changes.arrive(changes.counts(stream, "ts", "event_type"), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = batch.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    closed = {tuple(r) for r in want.collect()}
    assert got and got <= closed
