"""Chart payloads of a quote service (JSON) as bars, quotes and market context; chart requests; marks on a chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ticker
from ..functions.values import finite, ratio
from .bars import clamped_bars

# Fixed values of the service.
RANGES, INTERVALS, MOST_SYMBOLS = ("1d", "5d", "1mo", "3mo", "1y"), ("5m", "15m", "1h", "1d"), 100

_PAYLOAD = (
    "chart struct<error: string, result: array<struct<meta: struct<regularMarketPrice: double, previousClose: double, regularMarketTime: bigint, currency: string>, "
    "timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>>>>>"
)


def requests(rows: DataFrame) -> DataFrame:
    """Chart requests (symbol, range, interval) with the canonical symbol and the first thing that is wrong, or null."""
    symbol = ticker(F.col("symbol"))
    error = F.when(symbol.isNull(), "symbol").when(~F.coalesce(F.col("range").isin(*RANGES), F.lit(False)), "range").when(~F.coalesce(F.col("interval").isin(*INTERVALS), F.lit(False)), "interval")
    return rows.withColumns({"symbol": symbol, "error": error})


def quote_requests(rows: DataFrame) -> DataFrame:
    """Quote requests (request, symbols as text with commas): distinct canonical symbols, and what is wrong, or null."""
    given = F.filter(F.split(F.coalesce("symbols", F.lit("")), ","), lambda s: F.trim(s) != "")
    found = F.array_distinct(F.transform(given, ticker))
    error = F.when(F.size(given) == 0, "no symbols").when(F.exists(found, lambda s: s.isNull()), "symbol").when(F.size(found) > MOST_SYMBOLS, "too many symbols")
    return rows.select("request", F.when(error.isNull(), found).alias("symbols"), error.alias("error"))


def parsed(payloads: DataFrame) -> DataFrame:
    """(symbol, text, error) with the payload's first result as ``chart``, and null where there is none."""
    found = F.from_json("text", _PAYLOAD)
    return payloads.withColumn("chart", F.get(found["chart"]["result"], F.lit(0)))


def bars(payloads: DataFrame) -> DataFrame:
    """Bars (symbol, observed_at in Unix seconds, open, high, low, close, volume) of payloads that could be read.

    A row counts if its time and prices are numbers above 0. High and low are stretched to hold all prices, a missing or
    negative volume is 0, and of rows with one time the last wins.
    """
    quote = F.get(F.col("chart")["indicators"]["quote"], F.lit(0))
    names = ("open", "high", "low", "close", "volume")
    columns = F.arrays_zip(F.col("chart")["timestamp"].alias("observed_at"), *[quote[n].alias(n) for n in names])
    rows = parsed(payloads).select("symbol", F.posexplode(columns).alias("_ord", "b"))
    rows = rows.select("symbol", "_ord", "b.observed_at", *[finite(F.col(f"b.{n}")).alias(n) for n in names])
    positive = F.col("observed_at") > 0
    for n in names[:4]:
        positive = positive & (F.col(n) > 0)
    return clamped_bars(rows.where(positive))


def quotes(payloads: DataFrame) -> DataFrame:
    """One quote per payload (symbol, text, error): price, previous_close, change, change_pct, as_of, or the error.

    The price is the market's, else the last close; the previous close is stated, else the last but one.
    """
    meta = F.col("chart")["meta"]
    closes = F.filter(F.coalesce(F.get(F.col("chart")["indicators"]["quote"], F.lit(0))["close"], F.array().cast("array<double>")), lambda v: finite(v).isNotNull())
    price = finite(F.coalesce(meta["regularMarketPrice"], F.try_element_at(closes, F.lit(-1))))
    before = finite(F.coalesce(meta["previousClose"], F.try_element_at(closes, F.lit(-2))))
    rows = parsed(payloads).withColumns({"price": price, "previous_close": before, "as_of": F.timestamp_seconds(meta["regularMarketTime"])})
    error = F.coalesce("error", F.when(F.col("chart").isNull(), "no chart data").when(F.col("price").isNull(), "no latest price"))
    good = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    change = F.col("price") - F.col("previous_close")
    rows = rows.withColumns({"error": error, "change": change, "change_pct": F.lit(100.0) * ratio(change, F.col("previous_close"))})
    return rows.select("symbol", *[good(c) for c in ("price", "previous_close", "change", "change_pct", "as_of")], "error")


def market_context(chart_bars: DataFrame, neutral_pct: float = 0.5) -> DataFrame:
    """Tone of each symbol's bars from the first close to the last: change in percent, and the number of bars."""
    ends = chart_bars.groupBy("symbol").agg(F.min_by("close", "observed_at").alias("first"), F.max_by("close", "observed_at").alias("last"), F.count(F.lit(1)).alias("observations"))
    change = F.lit(100.0) * ratio(F.col("last") - F.col("first"), F.col("first"))
    tone = F.when(change > neutral_pct, "positive").when(change < -neutral_pct, "negative").otherwise("neutral")
    confidence = F.when(change.isNull(), "low").otherwise("medium")
    return ends.select("symbol", change.alias("change_pct"), tone.alias("tone"), confidence.alias("confidence"), "observations")


def target_price(baseline: Column, target_return_pct: Column) -> Column:
    """The price that a forecast's target return leads to; null without a positive baseline."""
    return F.when(baseline > 0, baseline * (1 + target_return_pct / 100))


def marks(chart_bars: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Bars with the forecast's target line (forecasts: symbol, baseline, target_return_pct) and whether volume stands under a rise."""
    lines = forecasts.select("symbol", target_price(F.col("baseline"), F.col("target_return_pct")).alias("target_price"))
    return chart_bars.join(lines, "symbol", "left").withColumn("volume_up", F.col("close") >= F.col("open"))


def latest(chart_bars: DataFrame, n: int) -> DataFrame:
    """Each symbol's last ``n`` bars."""
    order = Window.partitionBy("symbol").orderBy(F.desc("observed_at"))
    return chart_bars.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
