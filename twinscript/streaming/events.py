"""Windows over event streams, and sinks that resume. The same functions take batch and streaming frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, every: str, *by: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", every).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, length: str, step: str, *by: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", length, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, *key: str, late: str = "1 hour") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))
    return events.dropDuplicates(list(key))


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """All that is there, batch by batch, resuming at the checkpoint; write gets each batch and its number and must be idempotent."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def partition_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A batch to its own folder: repeating it after a failure replaces what it wrote."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
