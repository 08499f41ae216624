"""Regime reports over many documents at once: a local market's six signals, and global markets with exposures.

Points are rows (report, series, observed_at, value, _ord); a report is one document's name. Nothing after ``as_of`` is
read, and what a report lacks is null in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import positive_windows, seconds_between, sign
from . import series as S
from .regimes import interactions, latest_breadth, vote

LOCAL_SIGNALS = ("market_trend", "breadth", "flow", "flow_acceleration", "currency", "rate")


def _named(points: DataFrame) -> DataFrame:
    return points.withColumn("series", F.struct("report", "series"))


def _of(rows: DataFrame, role: str, columns: dict[str, str]) -> DataFrame:
    return rows.where(F.col("series.series") == role).select(F.col("series.report").alias("report"), *[F.col(a).alias(b) for a, b in columns.items()])


def _preferred(wanted: int, horizons: Sequence[int]) -> int:
    return wanted if wanted in horizons else horizons[-1]


def local_report(points: DataFrame, breadth: DataFrame, events: DataFrame, as_of: Column, horizons=(1, 5, 20), windows=(5, 20), fresh_seconds: float = 604_800) -> DataFrame:
    """One row per report of ``points`` whose series are market, flow, currency and rate.

    Trends and volatilities of the market, the last flow and its step, the currency's changes, the rate's last step, the
    last breadth row (report, observed_at, advancing, declining, unchanged, _ord), counts of macro events (report,
    released_at), six signals, their score and the regime. The market's trend speaks over 20 steps and the currency's
    change over 5 where those are among ``horizons``, else over the last of them.
    """
    horizons = positive_windows(horizons, "horizons")
    if fresh_seconds < 0:
        raise ValueError("fresh_seconds must not be negative")
    named = _named(points)
    priced = S.eligible(named.where(F.col("series.series").isin("market", "currency")), as_of, positive=True)
    other = S.eligible(named.where(F.col("series.series").isin("flow", "rate")), as_of)
    moved, steps = S.changes(priced, horizons), S.last_step(other)
    shaken = S.volatilities(priced.where(F.col("series.series") == "market"), windows)
    trend, fx = _preferred(20, horizons), _preferred(5, horizons)
    age = seconds_between(F.col("released_at"), as_of)
    ahead = F.col("released_at") > as_of
    macro = events.groupBy("report").agg(
        F.count_if(~ahead).alias("macro_count"), F.count_if(~ahead & (age <= fresh_seconds)).alias("macro_fresh_count"), F.count_if(ahead).alias("macro_future_count"),
        F.min(F.when(~ahead, age)).alias("macro_latest_age_seconds"),
    )
    out = points.select("report").distinct()
    for part in (
        _of(moved, "market", {"value": "market_latest"} | {f"change_{n}": f"market_trend_{n}" for n in horizons}),
        _of(shaken, "market", {f"volatility_{n}": f"market_volatility_{n}" for n in windows}),
        _of(steps, "flow", {"value": "flow_latest", "difference": "flow_step"}),
        _of(moved, "currency", {"value": "currency_latest"} | {f"change_{n}": f"currency_change_{n}" for n in horizons}),
        _of(steps, "rate", {"value": "rate_latest", "difference": "rate_change"}),
        latest_breadth(breadth, as_of, ["report"]).select("report", F.col("breadth").alias("breadth_value")),
        macro,
    ):
        out = out.join(part, "report", "left")
    rate = F.when(F.col("rate_change") <= 0, 1).when(F.col("rate_change") > 0, -1)
    values = [sign(F.col(f"market_trend_{trend}")), sign(F.col("breadth_value")), sign(F.col("flow_latest")), sign(F.col("flow_step")), sign(F.col(f"currency_change_{fx}"), inverse=True), rate]
    out = out.withColumns({f"{n}_signal": v for n, v in zip(LOCAL_SIGNALS, values, strict=True)} | {"rate_change_bps": F.col("rate_change") * 100})
    each = out.select("report", F.explode(F.array(*[F.col(f"{n}_signal") for n in LOCAL_SIGNALS])).alias("signal"))
    return out.join(vote(each, ["report"]), "report", "left")


def market_blocks(points: DataFrame, as_of: Column, horizons=(1, 5, 20), windows=(5, 20)) -> DataFrame:
    """Every series of every report: latest value, changes, volatilities, and what was left out."""
    named = _named(points)
    known = S.eligible(named, as_of, positive=True)
    out = S.availability(named, as_of, positive=True)
    for part in (S.changes(known, horizons).drop("observed_at").withColumnRenamed("value", "latest"), S.volatilities(known, windows)):
        out = out.join(part, "series", "left")
    return out.select("series.report", "series.series", *[c for c in out.columns if c != "series"])


def global_signals(blocks: DataFrame, horizon: int, equities: Sequence[str], fear: str, dollar: str, commodities: Sequence[str]) -> DataFrame:
    """(report, factor, signal): the dollar's sign, the risk appetite of equities and fear, and each commodity's sign."""
    s = sign(F.col(f"change_{horizon}"))
    risk = F.when(F.col("series").isin(*equities), s).when(F.col("series") == fear, -s)
    usd = F.max(F.when(F.col("series") == dollar, s)).alias("usd")
    found = blocks.groupBy("report").agg(usd, F.signum(F.avg(risk)).cast("int").alias("risk"), *[F.max(F.when(F.col("series") == c, s)).alias(c) for c in commodities])
    pairs = [F.struct(F.lit(n).alias("factor"), F.col(n).alias("signal")) for n in ("usd", "risk", *commodities)]
    return found.select("report", F.inline(F.array(*pairs)))


def global_report(points: DataFrame, exposures: DataFrame, as_of: Column, roles: dict, horizons=(1, 5, 20), windows=(5, 20), signal_horizon: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(market blocks, signals, interactions of exposures (report, symbol, factor, sensitivity) with signals)."""
    horizons = positive_windows(horizons, "horizons")
    chosen = horizons[-1] if signal_horizon is None else signal_horizon
    if chosen not in horizons:
        raise ValueError("signal_horizon must be one of horizons")
    blocks = market_blocks(points, as_of, horizons, windows)
    signals = global_signals(blocks, chosen, **roles)
    return blocks, signals, interactions(exposures, signals, ["report", "factor"])
