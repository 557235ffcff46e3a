from pyspark.sql import functions as F

from tessera.streaming import ingest

FIELDS = "plate string, well string, pos int, path string, acquisition int"


def table(spark, path):
    return sorted(tuple(r) for r in ingest.read_table(spark, path).collect())


def test_merge_is_idempotent_and_keeps_other_wells(spark, tmp_path):
    path = str(tmp_path / "t")
    have = [("p", f"A/{i}", 0, "0", 0) for i in range(30)]
    ingest.create_table(spark.createDataFrame(have, FIELDS), path, 4)
    new = spark.createDataFrame([("p", "A/3", "1", 0), ("p", "A/3", "1", 0), ("p", "A/3", "0", 0), ("p", "B/1", "0", 2)], "plate string, well string, path string, acquisition int")
    want = sorted([*have, ("p", "A/3", 1, "1", 0), ("p", "B/1", 0, "0", 2)])
    for _ in range(2):
        ingest.merge(new, path, 4)
        assert table(spark, path) == want
    ingest.merge(new.limit(0), path, 4)
    assert table(spark, path) == want


def test_stream_of_two_batches_with_late_repeats(spark, tmp_path):
    path, events = str(tmp_path / "t"), str(tmp_path / "e")
    ingest.create_table(spark.createDataFrame([("p", "A/1", 0, "0", 0)], FIELDS), path, 4)
    add = lambda rows: spark.createDataFrame(rows, "plate string, well string, path string, acquisition int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.mode("append").parquet(events)
    start = lambda: ingest.ingest(spark.readStream.schema(ingest.EVENTS).parquet(events), path, str(tmp_path / "c"), buckets=4).awaitTermination()
    add([("p", "A/1", "1", 0, 100), ("p", "A/1", "1", 0, 200)])
    start()
    add([("p", "A/1", "1", 0, 300), ("p", "A/1", "2", 0, 300), ("p", "A/1", "0", 0, 301)])
    start()
    assert table(spark, path) == [("p", "A/1", 0, "0", 0), ("p", "A/1", 1, "1", 0), ("p", "A/1", 2, "2", 0)]
