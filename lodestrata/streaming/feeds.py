"""The stateful parts of a crawl as Structured Streaming jobs: seen sets, counters, pacing, incremental upkeep.

Every stream is a plain transformation of a streaming DataFrame; the caller chooses source, sink, trigger and the
checkpoint folder, which on a cluster lies in the shared store. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.urls import hostname


def first_seen(stream: DataFrame, key: list[str], time_col: str, keep: str = "1 day") -> DataFrame:
    """Each key once within ``keep``: rows that repeat a key are dropped, late rows beyond it too."""
    return stream.withWatermark(time_col, keep).dropDuplicatesWithinWatermark(key)


def host_load(stream: DataFrame, url_col: str, time_col: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(host, window, requests) in tumbling windows; windows close when the watermark passes."""
    hosts = stream.withWatermark(time_col, late).withColumn("host", hostname(F.col(url_col)))
    return hosts.groupBy(F.window(time_col, window), "host").agg(F.count("*").alias("requests")).select("host", F.col("window.start").alias("window_start"), "requests")


def sessions(stream: DataFrame, key: str, time_col: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, events): activity without a pause longer than ``gap``."""
    w = F.session_window(time_col, gap)
    return stream.withWatermark(time_col, late).groupBy(w, key).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def upsert_by_key(target: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends the last row of each key of a batch under the batch's own folder.

    Writing a batch again, after a restart, overwrites that folder: the sink is idempotent. ``current`` reads the state.
    """
    from lodestrata.operators.dedup import latest

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def current(spark, target: str, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key over all batches."""
    from lodestrata.operators.dedup import latest

    return latest(spark.read.parquet(target).drop("batch"), key, order)


def index_changes(target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for pages (key, hash): writes what each batch adds, changes or leaves as it was.

    The state is what earlier batches wrote, the newest hash of each key; a batch that is run again, after a restart,
    sees the same earlier batches and overwrites its own folder. Keys a batch does not hold are left alone.
    """
    from lodestrata.operators.dedup import latest
    from lodestrata.operators.index import incremental

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("key").agg(F.max("hash").alias("hash"))
        before = [f"{target}/batch={b}" for b in range(batch_id)]
        read = [p for p in before if _exists(spark, p)]
        if read:
            old = latest(spark.read.option("basePath", target).parquet(*read), ["key"], ["batch"]).select("key", "hash")
            actions = incremental(old.join(new.select("key"), "key", "left_semi"), new)
        else:
            actions = new.select("key", F.lit("added").alias("action"))
        actions.join(new, "key").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def _exists(spark, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True
