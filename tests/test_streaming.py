"""Windowed counts give the same rows for a stream as for its table."""

from pyspark.sql import functions as F

from umbra.streaming.counts import windowed_counts


def test_stream_equals_table(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type").write.parquet(source)
    table = spark.read.parquet(source)
    want = {(r.window_start, r.event_type, r.n) for r in windowed_counts(table, "ts", "event_type", late="365 days").collect()}
    stream = windowed_counts(spark.readStream.schema(table.schema).parquet(source), "ts", "event_type", late="365 days")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.table("counts").groupBy("window_start", "event_type").agg(F.max("n").alias("n"))
    assert {(r.window_start, r.event_type, r.n) for r in last.collect()} == want and want
