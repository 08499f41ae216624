"""Point series (series, observed_at, value, _ord): what is known at ``as_of``, changes, volatility and latest values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import finite, positive_windows, ratio


def _valid(positive: bool) -> Column:
    value = finite(F.col("value"))
    return F.coalesce(F.col("observed_at").isNotNull() & value.isNotNull() & ((value > 0) if positive else F.lit(True)), F.lit(False))


def eligible(points: DataFrame, as_of: Column, positive: bool = False) -> DataFrame:
    """Points that are valid and not ahead of ``as_of``."""
    return points.where(_valid(positive) & (F.col("observed_at") <= as_of))


def availability(points: DataFrame, as_of: Column, positive: bool = False) -> DataFrame:
    """For each series: points that count, points ahead of ``as_of``, invalid points, and the latest time that counts."""
    ok = _valid(positive)
    now = ok & (F.col("observed_at") <= as_of)
    counts = points.groupBy("series").agg(
        F.count_if(now).alias("eligible_count"), F.count_if(ok & (F.col("observed_at") > as_of)).alias("excluded_future_count"), F.count_if(~ok).alias("invalid_count"),
        F.max(F.when(now, F.col("observed_at"))).alias("latest_observed_at"),
    )
    return counts.withColumn("status", F.when(F.col("eligible_count") > 0, "available").otherwise("unavailable"))


def _order():
    return Window.partitionBy("series").orderBy("observed_at", "_ord")


def _last(points: DataFrame, columns: list[str]) -> DataFrame:
    held = points.groupBy("series").agg(F.max_by(F.struct(*columns), F.struct("observed_at", "_ord")).alias("last"))
    return held.select("series", *[F.col(f"last.`{c}`").alias(c) for c in columns])


def changes(points: DataFrame, horizons: Iterable[int] = (1, 5, 20), difference: bool = False) -> DataFrame:
    """Each series' latest value and its change from n values earlier (n + 1 values are needed): share, or difference."""
    names = positive_windows(horizons, "horizons")
    value = F.col("value")
    then = lambda n: F.lag("value", n).over(_order())
    out = points.select("series", "observed_at", "_ord", "value", *[((value - then(n)) if difference else (ratio(value, then(n)) - 1)).alias(f"change_{n}") for n in names])
    return _last(out, ["observed_at", "value", *[f"change_{n}" for n in names]])


def volatilities(points: DataFrame, windows: Iterable[int] = (5, 20)) -> DataFrame:
    """Population deviation of each series' last n one-step returns; null unless there are n."""
    names = positive_windows(windows, "windows")
    stepped = points.withColumn("step", ratio(F.col("value"), F.lag("value").over(_order())) - 1)
    frame = lambda n: _order().rowsBetween(-(n - 1), 0)
    out = stepped.select("series", "observed_at", "_ord", *[F.when(F.count("step").over(frame(n)) == n, F.stddev_pop("step").over(frame(n))).alias(f"volatility_{n}") for n in names])
    return _last(out, [f"volatility_{n}" for n in names])


def last_step(points: DataFrame) -> DataFrame:
    """Each series' latest value and its difference from the value before: acceleration of flows, change of rates."""
    return _last(points.withColumn("difference", F.col("value") - F.lag("value").over(_order())), ["value", "difference"])
