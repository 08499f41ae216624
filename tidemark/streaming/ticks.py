"""Ticks as a stream: tumbling bars, sessions and deduplication, with watermarks; the same functions take batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(ticks: DataFrame, late: str) -> DataFrame:
    """``ts`` as a TIMESTAMP, which watermarks need."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_bars(ticks: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bars of each symbol and window; a window is emitted once the watermark has passed it."""
    found = _timed(ticks, late).groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count(F.lit(1)).alias("ticks"),
    )
    return found.select("symbol", F.col("window.start").alias("bar_time"), "open", "high", "low", "close", "ticks")


def sessions(ticks: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs of a symbol's ticks without a pause of ``gap``."""
    found = _timed(ticks, late).groupBy(F.session_window("ts", gap), "symbol").agg(F.count(F.lit(1)).alias("ticks"))
    return found.select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "ticks")


def first_of_each(ticks: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Ticks without those that repeat a key within the watermark."""
    return _timed(ticks, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that its source holds now, to Parquet, exactly once."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
