from datetime import datetime, timedelta

from pyspark.sql import functions as F
from vacantia.streaming import pipelines

T0 = datetime(2026, 1, 1)


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_rolling_postings(spark, tmp_path):
    schema = "id string, employer string, created timestamp"
    feed(spark, f"{tmp_path}/in", [("1", "a", T0), ("1", "a", T0 + timedelta(hours=1)), ("2", "a", T0), ("3", "b", T0 + timedelta(days=1))], schema)
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = pipelines.rolling_postings(stream, "id", "employer", "created", 2, "2 days").writeStream.format("memory").queryName("rolling").outputMode("complete").start()
    q.processAllAvailable()
    got = {(r.employer, r.postings) for r in spark.sql("SELECT * FROM rolling").collect()}
    q.stop()
    assert got == {("a", 2), ("b", 1)}


def test_new_since_over_restarts(spark, tmp_path):
    schema = "watch_id string, id string"
    run = lambda: pipelines.new_since_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/seen", f"{tmp_path}/out", f"{tmp_path}/cp", ["watch_id", "id"]).awaitTermination()
    feed(spark, f"{tmp_path}/in", [("w", "1"), ("w", "1"), ("v", "1")], schema)
    run()
    feed(spark, f"{tmp_path}/in", [("w", "1"), ("w", "2")], schema)
    run()
    run()
    assert sorted((r.watch_id, r.id, r.batch) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("v", "1", 0), ("w", "1", 0), ("w", "2", 1)]


def test_partitions_are_replaced(spark, tmp_path):
    schema = "source_slug string, id string, fetched_at timestamp"
    run = lambda: pipelines.replace_partitions_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/jobs", f"{tmp_path}/cp").awaitTermination()
    feed(spark, f"{tmp_path}/in", [("a", "1", T0), ("a", "2", T0), ("b", "3", T0)], schema)
    run()
    feed(spark, f"{tmp_path}/in", [("a", "9", T0 + timedelta(days=1)), ("a", "8", T0)], schema)
    run()
    assert sorted((r.source_slug, r.id) for r in spark.read.parquet(f"{tmp_path}/jobs").collect()) == [("a", "9"), ("b", "3")]


def test_index_pages_go_on_after_a_restart(spark, tmp_path):
    run = lambda: pipelines.index_pages_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text('{"url":"https://jobs.lever.co/a"}\nbad\n')
    run()
    (tmp_path / "in/2.txt").write_text('{"url":"https://jobs.lever.co/b"}\n')
    run()
    assert sorted(r.token for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_usage_batches(spark, tmp_path):
    feed(spark, f"{tmp_path}/in", [(T0 + timedelta(seconds=k), k) for k in range(60)], "ts timestamp, n int")
    posts = []
    pipelines.usage_stream(spark.readStream.schema("ts timestamp, n int").parquet(f"{tmp_path}/in"), lambda rows: posts.append([r["n"] for r in rows]), f"{tmp_path}/cp", 25, 55).awaitTermination()
    assert [len(p) for p in posts] == [25, 25, 5] and posts[0][0] == 5 and posts[-1][-1] == 59


def test_sources_are_plain_frames(spark):
    assert spark.range(3).select(F.col("id")).isStreaming is False
