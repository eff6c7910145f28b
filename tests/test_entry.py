import __spark_entry__ as entry


def test_registry_is_consistent():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 60


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_streams_equal_batches(spark, tmp_path):
    from lexiloom.streaming import events

    df = spark.createDataFrame([(1, "a", "2024-01-01 00:10:00", 1.0), (1, "a", "2024-01-01 00:50:00", 2.0), (2, "b", "2024-01-01 05:00:00", 3.0)], "user_id int, event_type string, ts string, value double").selectExpr("user_id", "event_type", "cast(ts as timestamp) ts", "value")
    df.write.parquet(str(tmp_path / "e"))
    q = events.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("w")) == key(events.windowed(df))
    assert events.sessions(df).count() == 3
