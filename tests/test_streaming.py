"""The streaming counts equal the batch ones, late events included."""

from depotry.streaming.demand import demand_by_window, keep_latest, latest


def test_stream_equals_batch(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", 1), ("2024-01-01 11:00:00", 1), ("2024-01-02 01:00:00", 2), ("2024-01-01 23:30:00", 2), ("2024-01-05 00:00:00", 3)]
    events = spark.createDataFrame(rows, "t string, key int").selectExpr("CAST(t AS timestamp) AS ts", "key")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    job = demand_by_window(stream, "key").writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(keep_latest(out)).start()
    job.processAllAvailable()
    job.stop()
    got = spark.read.parquet(out).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, demand_by_window(events, "key").collect()))


def test_a_window_that_grows_counts_once(spark, tmp_path):
    parts = [[("2024-01-01 10:00:00", 1)], [("2024-01-01 11:00:00", 1), ("2024-01-01 12:00:00", 2)], [("2024-01-01 13:00:00", 1)]]
    frames = [spark.createDataFrame(p, "t string, key int").selectExpr("CAST(t AS timestamp) AS ts", "key") for p in parts]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        job = demand_by_window(stream, "key").writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(keep_latest(out)).start()
        job.processAllAvailable()
        job.stop()
    want = demand_by_window(spark.read.parquet(str(tmp_path / "in")), "key")
    assert sorted(map(str, latest(spark, out, "key").collect())) == sorted(map(str, want.collect()))
    assert spark.read.parquet(out).count() > want.count()
