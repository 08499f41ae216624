"""Quality of a quote and its bars: ordered issue codes and a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import age_seconds, ordered_codes, ratio

STALE_SECONDS, THIN_RATIO, LIMIT_PERCENT = 900.0, 0.25, 20.0


def latest_bars(bars: DataFrame) -> DataFrame:
    """Each symbol's latest bar, how many there are, and its volume against the mean of earlier positive volumes."""
    prior = Window.partitionBy("symbol").orderBy("bar_time").rowsBetween(Window.unboundedPreceding, -1)
    rated = bars.withColumn("prior_volume", F.avg(F.when(F.col("volume") > 0, F.col("volume"))).over(prior))
    held = rated.groupBy("symbol").agg(F.max_by(F.struct("bar_time", "high", "low", "close", "volume", "prior_volume"), "bar_time").alias("b"), F.count(F.lit(1)).alias("valid_bar_count"))
    return held.select("symbol", "valid_bar_count", "b.*")


def assess(quotes: DataFrame, bars: DataFrame, as_of, stale_seconds: float = STALE_SECONDS, thin_ratio: float = THIN_RATIO, limit_percent: float = LIMIT_PERCENT) -> DataFrame:
    """One row per quote (symbol, price, previous_close, observed_at, corporate_action, suspended, raw_bar_count).

    Unavailable: the quote is missing or invalid. Partial: any other issue. A null ``missing`` symbol's quote is a row
    whose price, time and previous close are all null and ``missing`` is true.
    """
    if min(stale_seconds, thin_ratio, limit_percent) < 0:
        raise ValueError("thresholds of quality must not be negative")
    rows = quotes.join(latest_bars(bars), "symbol", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    missing = yes(F.col("missing"))
    price, before = F.col("price"), F.col("previous_close")
    invalid = ~missing & (price.isNull() | (price <= 0) | F.col("observed_at").isNull())
    age, delay = age_seconds(F.col("observed_at"), as_of), age_seconds(F.col("bar_time"), as_of)
    age, delay = F.when(F.col("observed_at").isNotNull(), age), F.when(F.col("bar_time").isNotNull(), delay)
    volume_ratio = ratio(F.col("volume"), F.col("prior_volume"))
    move = F.lit(100.0) * ratio(price - before, F.when(before > 0, before))
    n = F.coalesce("valid_bar_count", F.lit(0))
    stale, thin = yes(age > stale_seconds), yes(F.col("volume") <= 0) | yes(volume_ratio < thin_ratio)
    limit, corporate = yes(F.abs(move) >= limit_percent), yes(F.col("corporate_action"))
    suspended = yes(F.col("suspended")) | (yes(F.col("volume") == 0) & price.eqNullSafe(before))
    no_bars, bad_bars = n == 0, yes(F.col("raw_bar_count") > n)
    issues = ordered_codes(
        (missing, "missing_quote"), (invalid, "invalid_quote"), (no_bars, "missing_bars"), (bad_bars, "invalid_bars"), (stale, "stale_quote"),
        (thin, "thin_liquidity"), (corporate, "corporate_action"), (limit, "limit_move"), (suspended, "possible_suspension"),
    )
    status = F.when(missing | invalid, "unavailable").when(F.size(issues) > 0, "partial").otherwise("ok")
    return rows.select(
        "symbol", status.alias("status"), issues.alias("issues"), age.alias("age_seconds"), delay.alias("delay_seconds"), n.cast("bigint").alias("valid_bar_count"),
        (F.col("close") * F.col("volume")).alias("turnover"), volume_ratio.alias("volume_ratio"), (F.lit(100.0) * ratio(F.col("high") - F.col("low"), F.col("close"))).alias("range_percent"), move.alias("move_percent"),
    )


def quote_ages(rows: DataFrame, max_age: float, keys: list[str] | None = None) -> DataFrame:
    """Observed, stale and missing ages, their range, and a status."""
    age = F.when(F.col("age_seconds") >= 0, F.col("age_seconds"))
    found = (rows.groupBy(*keys) if keys else rows.groupBy()).agg(
        F.count(age).alias("observed"), F.count_if(age > max_age).alias("stale"), F.count_if(age.isNull()).alias("missing"), F.min(age).alias("min_age_seconds"), F.max(age).alias("max_age_seconds"),
    )
    return found.withColumn("status", F.when(F.col("observed") == 0, "unavailable").when(F.col("stale") > 0, "stale").otherwise("fresh"))
