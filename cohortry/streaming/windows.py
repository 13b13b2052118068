"""Structured Streaming extensions: late-tolerant time bins, and incremental topic assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_bins(events: DataFrame, ts: str, by: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each bin; a bin closes when the watermark passes it, so state stays bounded."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def assign_each_batch(stream: DataFrame, assign: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Adds new documents as they come: each micro-batch is assigned and written under its own number, so a batch that runs again replaces itself."""

    def put(df: DataFrame, epoch: int) -> None:
        assign(df).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
