"""Quotes, ticks and bars in canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import first_given, lenient_number, parse_time, ratio


def bars_from_ticks(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Open, high, low, close, volume and count of ticks (symbol, ts, price, volume) for each symbol and ``unit``.

    Partial aggregates run before the one shuffle by (symbol, time).
    """
    at = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz").alias("bar_time")
    return ticks.groupBy("symbol", at).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks"),
    )


def _raw(frame: DataFrame, *names: str) -> Column:
    """The first given of the alias columns that the frame has."""
    have = [F.col(f"`{n}`").cast("string") for n in names if n in frame.columns]
    return first_given(*have) if have else F.lit(None).cast("string")


def canonical_quotes(raw: DataFrame) -> DataFrame:
    """Quotes of any known layout as symbol, price, volume, observed_at, previous_close."""
    return raw.select(
        "symbol",
        lenient_number(_raw(raw, "price", "last", "regularMarketPrice", "close")).alias("price"),
        lenient_number(_raw(raw, "volume", "regularMarketVolume")).alias("volume"),
        parse_time(_raw(raw, "observed_at", "observedAt", "timestamp", "time", "regularMarketTime")).alias("observed_at"),
        lenient_number(_raw(raw, "previous_close", "previousClose", "regularMarketPreviousClose")).alias("previous_close"),
    )


def canonical_bars(raw: DataFrame) -> DataFrame:
    """Bars with positive prices whose high and low hold open and close; others go. Null volume is 0."""
    out = raw.select(
        "symbol",
        parse_time(_raw(raw, "observed_at", "observedAt", "timestamp", "time")).alias("observed_at"),
        *[lenient_number(_raw(raw, n)).alias(n) for n in ("open", "high", "low", "close")],
        F.coalesce(lenient_number(_raw(raw, "volume")), F.lit(0.0)).alias("volume"),
    )
    positive = (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)
    sound = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    return out.where(F.col("observed_at").isNotNull() & positive & sound & (F.col("volume") >= 0))


def clamped_bars(raw: DataFrame) -> DataFrame:
    """Chart bars: high and low stretched to hold open and close, volume at least 0, the last row of a time wins.

    ``_ord`` is the place of a row in its feed.
    """
    last = raw.where("open is not null and close is not null").groupBy("symbol", "observed_at").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "_ord").alias("b"))
    high = F.greatest("b.open", "b.close", "b.high", "b.low")
    low = F.least("b.open", "b.close", "b.low", "b.high")
    return last.select("symbol", "observed_at", "b.open", high.alias("high"), low.alias("low"), "b.close", F.greatest(F.lit(0.0), F.coalesce("b.volume", F.lit(0.0))).alias("volume"))


def quote_change(bars: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """Each symbol's last close against the close before it: price, previous_close, change, change_pct."""
    order = Window.partitionBy("symbol").orderBy("bar_time")
    latest = bars.withColumn("prev", F.lag("close").over(order)).groupBy("symbol").agg(F.max_by(F.struct("close", "prev"), "bar_time").alias("q"))
    price, before = F.col("q.close"), F.col("q.prev")
    return latest.select("symbol", price.alias("price"), before.alias("previous_close"), (price - before).alias("change"), (F.lit(100.0) * ratio(price - before, before)).alias("change_pct"))
