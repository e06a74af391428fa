from pyspark.sql import functions as F

from quirefold.plans import fixture
from quirefold.sources import sinks
from quirefold.streaming.requests import counters, lifetime_ms, watch_log


def test_watch_log_keeps_one_of_each_key(spark, tmp_path):
    rows = [("a", 1), ("a", 2), ("b", 3)]
    spark.createDataFrame(rows, "key string, n int").withColumn("ts", F.timestamp_seconds("n")).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("key string, n int, ts timestamp").parquet(str(tmp_path / "log"))
    q = watch_log(stream).writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["key"] for r in spark.sql("SELECT key FROM watched").collect()) == ["a", "b"]


def test_lifetimes_and_counters(spark):
    log = spark.createDataFrame([(404, "x", "u", "k1", True), (200, "null", "u", "k1", True), (200, "{}", "https://api/works/10.1/x", "k2", False), (429, "{}", "https://arxiv.org/abs/1", "k3", True)], "status int, body string, url string, key string, allowed boolean")
    assert [r[0] for r in log.select(lifetime_ms(F.col("status"), F.col("body"), F.col("url"))).collect()] == [900_000, 900_000, 604_800_000, 86_400_000]
    row = counters(log).first()
    assert (row["requests"], row["deduplicated"], row["rate_limited"], row["circuit_skips"]) == (3, 1, 1, 1)


def test_undo_table_and_catalogue(spark, tmp_path):
    items = spark.createDataFrame([("a", "x"), ("b", "y")], "item_key string, title string")
    proposals = spark.createDataFrame([("a", "conferencePaper"), ("b", None)], "item_key string, target_item_type string")
    sinks.write_undo(items, proposals, str(tmp_path / "undo"), 1)
    sinks.write_undo(items.where("item_key = 'a'"), proposals, str(tmp_path / "undo"), 2)
    assert [tuple(r) for r in sinks.latest_undo(spark, str(tmp_path / "undo")).collect()] == [("a", "x")]
    sinks.write_catalogue(fixture.catalogue(spark), str(tmp_path / "c"))
    assert sinks.scan_items(spark, str(tmp_path / "c"), ("canonical",)).count() == 10
