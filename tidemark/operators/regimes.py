"""Votes of signed signals on the market's regime, exposures to it, breadth rows and macro events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ratio, seconds_between


def vote(signals: DataFrame, keys: list[str], min_signals: int = 3, threshold: int = 2) -> DataFrame:
    """Regime of each group from rows of (keys, name, signal in -1, 0, 1): the sum decides if enough signals are known."""
    if min_signals <= 0 or threshold <= 0:
        raise ValueError("thresholds of a vote must be positive")
    s = F.when(F.col("signal").isin(-1, 0, 1), F.col("signal"))
    found = signals.groupBy(*keys).agg(F.sum(s).cast("bigint").alias("score"), F.count(s).alias("available_signals"))
    score = F.col("score")
    regime = F.when(F.col("available_signals") < min_signals, None).when(score >= threshold, "risk_on").when(score <= -threshold, "risk_off").otherwise("neutral")
    return found.withColumn("regime", regime)


def risk_signal(equity_changes: DataFrame, vix_change: Column, keys: list[str]) -> DataFrame:
    """Sign of the mean of equity signs and the inverse sign of volatility, over those that are known."""
    found = equity_changes.groupBy(*keys).agg(F.sum(F.signum("change")).alias("s"), F.count("change").alias("n"), F.first(vix_change, ignorenulls=True).alias("v"))
    total = F.coalesce("s", F.lit(0.0)) - F.coalesce(F.signum("v"), F.lit(0.0))
    n = F.col("n") + F.when(F.col("v").isNotNull(), 1).otherwise(0)
    return found.select(*keys, F.when(n > 0, F.signum(total / n)).cast("int").alias("risk"))


def mapped_exposures(symbols: DataFrame, sectors: DataFrame, own: DataFrame, inherited: DataFrame) -> DataFrame:
    """A symbol's own exposures (symbol, exposure) as a whole, or its sector's (sector, exposure); where they come from."""
    rows = symbols.select("symbol").join(sectors.select("symbol", F.nullif(F.trim("sector"), F.lit("")).alias("sector")), "symbol", "left")
    rows = rows.join(own.select("symbol", F.col("exposure").alias("own")), "symbol", "left").join(inherited.select("sector", F.col("exposure").alias("of_sector")), "sector", "left")
    source = F.when(F.col("own").isNotNull(), "symbol").when(F.col("of_sector").isNotNull(), "sector")
    return rows.select("symbol", "sector", source.alias("exposure_source"), F.coalesce("own", "of_sector").alias("exposure"))


def interactions(exposures: DataFrame, signals: DataFrame, keys: tuple | list = ("factor",)) -> DataFrame:
    """(symbol, factor, sensitivity) times the factor's signal; null if either is unknown."""
    return exposures.join(signals, list(keys), "left").withColumn("interaction", F.col("sensitivity") * F.col("signal"))


def latest_breadth(rows: DataFrame, as_of: Column, keys: tuple | list = ()) -> DataFrame:
    """Of each key the last valid breadth row (observed_at, advancing, declining, unchanged, _ord) that is not ahead, and counts."""
    total = F.col("advancing") + F.col("declining") + F.coalesce("unchanged", F.lit(0.0))
    least = F.least("advancing", "declining", F.coalesce("unchanged", F.lit(0.0)))
    ok = F.coalesce(F.col("observed_at").isNotNull() & F.col("advancing").isNotNull() & F.col("declining").isNotNull() & (least >= 0), F.lit(False))
    now = ok & (F.col("observed_at") <= as_of) & (total > 0)
    share = ratio(F.col("advancing") - F.col("declining"), total)
    held = rows.groupBy(*keys).agg(
        F.max_by(F.when(now, F.struct("advancing", "declining", total.alias("available"), share.alias("breadth"))), F.when(now, F.struct("observed_at", "_ord"))).alias("last"),
        F.count_if(now).alias("eligible_count"), F.count_if(ok & (F.col("observed_at") > as_of)).alias("excluded_future_count"),
        F.count_if(~ok | (F.col("observed_at") <= as_of) & ~(total > 0)).alias("invalid_count"),
    )
    return held.select(*keys, "last.*", "eligible_count", "excluded_future_count", "invalid_count")


def macro_events(events: DataFrame, as_of: Column, fresh_seconds: float) -> DataFrame:
    """Events released by ``as_of`` with their age and whether they are fresh; order newest first at the sink."""
    age = seconds_between(F.col("released_at"), as_of)
    return events.where(F.col("released_at") <= as_of).withColumns({"age_seconds": age, "fresh": age <= fresh_seconds})
