
from sparkweld.streaming.dedupe import first_of_key


def test_stream_keeps_one_of_each_key(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = first_of_key(stream, ("user_id", "event_type"), lateness="1000 days").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type").distinct()
    got = spark.table("firsts").select("user_id", "event_type")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_static(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert first_of_key(df, ("a", "b")).count() == 2
