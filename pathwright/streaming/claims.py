"""Claims as a stream: each key processed once, results appended, restarts going on where they ended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def once_each(stream: DataFrame, key: Sequence[str], at: str, lateness: str = "1 day") -> DataFrame:
    """The first arrival of each key within the watermark; later ones, and rows later than it, are dropped. The state is bounded by the watermark."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(key))


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: Sequence[str]) -> StreamingQuery:
    """Runs work on every micro-batch and appends its rows to a Parquet table partitioned by batch, so that a batch that is run again after a failure
    replaces its own rows."""

    def step(batch: DataFrame, number: int) -> None:
        work(batch.dropDuplicates(list(key))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, at: str, window: str = "1 hour", lateness: str = "2 hours", by: Sequence[str] = ()) -> DataFrame:
    """(window_start, by, n): rows per tumbling window, given out when the watermark has passed it."""
    g = stream.withWatermark(at, lateness).groupBy(F.window(at, window).alias("_w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("_w.start").alias("window_start"), *by, "n")
