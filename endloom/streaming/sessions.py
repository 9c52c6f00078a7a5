"""Streaming forms: single-linkage clusters over event time and running weighted sums.

The same function serves a static frame and a stream: session windows are gaps-and-islands
with a watermark. Running position sums merge each micro-batch into a keyed table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_clusters(events: DataFrame, key: str, ts: str, gap_seconds: int, watermark: str | None = None) -> DataFrame:
    """key, start_us, end_us (of the last event), n for runs of events less than the gap
    apart. A stream needs a watermark; late events beyond it are dropped by Spark."""
    e = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    if watermark:
        e = e.withWatermark("ts", watermark)
    runs = e.groupBy("key", F.session_window("ts", f"{gap_seconds} seconds")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n"))
    return runs.select("key", F.unix_micros("a").alias("start_us"), F.unix_micros("b").alias("end_us"), "n")


def running_counts(events: DataFrame, key: str, ts: str, weight: str, window: str, watermark: str) -> DataFrame:
    """Windowed sums of weight by key: the incremental form of a weighted position index."""
    e = events.withWatermark(ts, watermark)
    return e.groupBy(F.window(ts, window).alias("w"), F.col(key).alias("key")).agg(F.sum(F.coalesce(F.col(weight), F.lit(1.0))).alias("total"), F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), "total", "n")


def merge_partial_sums(path: str, keys: list[str], value: str):
    """A foreachBatch function that appends partial sums of each micro-batch, tagged with the
    batch, so a batch that is written again replaces itself; read_sums() adds them up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(F.sum(value).alias(value)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_sums(spark, path: str, keys: list[str], value: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum(value).alias(value))
