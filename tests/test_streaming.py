import tempfile

from pyspark.sql import functions as F

from lodestrata.streaming import feeds

SCHEMA = "id long, url string, at timestamp"


def _stream(spark, rows):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "id long, url string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(f"{folder}/in/{k}")
    return folder, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def _run(df, folder, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql("SELECT * FROM out").collect()


ROWS = [[(1, "https://a.example/x", "2024-01-01 00:00:00"), (2, "https://a.example/x", "2024-01-01 00:01:00")], [(3, "https://b.example/y", "2024-01-01 00:02:00"), (4, "https://a.example/x", "2024-01-01 00:03:00")]]


def test_first_seen(spark):
    folder, s = _stream(spark, ROWS)
    got = _run(feeds.first_seen(s, ["url"], "at"), folder)
    assert sorted(r.url for r in got) == ["https://a.example/x", "https://b.example/y"]


def test_host_load(spark):
    folder, s = _stream(spark, ROWS)
    got = {(r.host, r.requests) for r in _run(feeds.host_load(s, "url", "at"), folder, "complete")}
    assert got == {("a.example", 3), ("b.example", 1)}


def test_upsert_is_idempotent(spark):
    folder, s = _stream(spark, ROWS)
    write = feeds.upsert_by_key(f"{folder}/out", ["url"], ["at", "id"])
    for _ in range(2):  # the same batches written again change nothing
        for k, part in enumerate(ROWS):
            write(spark.createDataFrame(part, "id long, url string, at string"), k)
    got = {r.url: r.id for r in feeds.current(spark, f"{folder}/out", ["url"], ["at", "id"]).collect()}
    assert got == {"https://a.example/x": 4, "https://b.example/y": 3}


def test_index_changes_batch_by_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    write = feeds.index_changes(f"{folder}/out")
    batches = [[("a", "1"), ("b", "1")], [("a", "1"), ("b", "2"), ("c", "1")], [("b", "2"), ("c", "2"), ("c", "2")]]
    for _ in range(2):
        for k, rows in enumerate(batches):
            write(spark.createDataFrame(rows, "key string, hash string"), k)
    got = {(r.batch, r.key): r.action for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {(0, "a"): "added", (0, "b"): "added", (1, "a"): "skipped", (1, "b"): "changed", (1, "c"): "added", (2, "b"): "skipped", (2, "c"): "changed"}
