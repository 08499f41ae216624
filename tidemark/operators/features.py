"""Trailing features of bars and quotes; a frame that is not full gives null, and nothing ahead of the quote is read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.values import positive_windows, quotient, ratio

HORIZONS, WINDOWS, ATR, MOMENTUM = (1, 5, 20), (5, 20), 14, 5


def full(value: Column, over: Column, n: int, frame) -> Column:
    """``over`` where the frame holds ``n`` values of ``value``."""
    return F.when(F.count(value).over(frame) == n, over.over(frame))


def _framed(rows: DataFrame, by: WindowSpec, horizons: list[int], windows: list[int], atr: int, zeros: bool) -> DataFrame:
    """What bars know from the bars before them in frames of bounded length, in the partitions and order of ``by``."""
    by_price = quotient if zeros else ratio
    frame = lambda n: by.rowsBetween(-(n - 1), 0)
    before = F.lag("close").over(by)
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    out = rows.withColumns({
        "before": before,
        "step": by_price(close, before) - 1,
        "true_range": F.when(before.isNotNull(), F.greatest(high - low, F.abs(high - before), F.abs(low - before))),
    } | {f"close_{n}": F.lag("close", n - 1).over(by) for n in sorted({*horizons, 1, MOMENTUM})}
      | {f"high_{n}": full(high, F.max("high"), n, frame(n)) for n in windows}
      | {f"low_{n}": full(low, F.min("low"), n, frame(n)) for n in windows})
    return out.withColumns(
        {
            "gap": by_price(F.col("open"), F.col("before")) - 1,
            "range": by_price(high - low, close),
            "close_location": ratio(close - low, high - low),
            f"average_true_range_{atr}": by_price(full(F.col("true_range"), F.avg("true_range"), atr, frame(atr)), close),
        }
        | {f"volatility_{n}": full(F.col("step"), F.stddev_pop("step"), n, frame(n)) for n in windows}
    )


def _traded() -> Column:
    return F.when(F.col("volume") > 0, F.col("volume"))


def trailing(bars: DataFrame, horizons: Iterable[int] = HORIZONS, windows: Iterable[int] = WINDOWS, atr: int = ATR, zeros: bool = False) -> DataFrame:
    """``bars`` with what each bar knows of itself and the bars before it: one shuffle, and one sort, by symbol.

    What is divided by a price of 0 is null; with ``zeros``, infinite or NaN, as in SQL.
    """
    horizons, windows = positive_windows(horizons, "horizons"), positive_windows(windows, "windows")
    by = Window.partitionBy("symbol").orderBy("bar_time")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    out = bars.withColumns({"bar_count": F.count(F.lit(1)).over(so_far), "mean_volume": F.avg(_traded()).over(so_far)})
    return _framed(out, by, horizons, windows, atr, zeros)


def _bucket(at: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000))


def trailing_in_blocks(bars: DataFrame, horizons: Iterable[int] = HORIZONS, windows: Iterable[int] = WINDOWS, atr: int = ATR, bucket_seconds: int = 86_400, block_bars: int = 4096, zeros: bool = False) -> DataFrame:
    """``trailing`` for symbols of any size: no task needs all bars of a symbol.

    1. Bars are numbered within buckets of time of their symbol. Numbers of bars, and volumes, of the buckets before are
       carried on by a running sum over buckets, of which a symbol has few; so every bar knows its place, and all that
       frames without a beginning tell.
    2. Places are cut to blocks of ``block_bars``. The last bars of a block are also given to the next one, as many as the
       longest frame looks back, and leave it again when the frames are reckoned.

    Bars without a symbol or a time are left out.
    """
    horizons, windows = positive_windows(horizons, "horizons"), positive_windows(windows, "windows")
    reach = max(*horizons, *windows, atr, MOMENTUM) + 1
    size = max(block_bars, reach)
    held = bars.withColumns({"_bucket": _bucket("bar_time", bucket_seconds), "_traded": _traded()})
    per = held.groupBy("symbol", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.count("_traded").alias("_k"), F.sum("_traded").alias("_v"))
    earlier = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("symbol", "_bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", "_k", "_v")])
    inside = Window.partitionBy("symbol", "_bucket").orderBy("bar_time").rowsBetween(Window.unboundedPreceding, 0)
    placed = held.withColumns({"_n1": F.count(F.lit(1)).over(inside), "_k1": F.count("_traded").over(inside), "_v1": F.coalesce(F.sum("_traded").over(inside), F.lit(0.0))})
    placed = placed.join(carried, ["symbol", "_bucket"])
    place = F.col("_n0") + F.col("_n1") - 1
    block = F.floor(place / size)
    at_end = place % size >= size - reach
    known = placed.select(
        *bars.columns, (place + 1).alias("bar_count"), ratio(F.col("_v0") + F.col("_v1"), F.col("_k0") + F.col("_k1")).alias("mean_volume"), block.alias("_own"),
        F.explode(F.when(at_end, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"),
    )
    out = _framed(known, Window.partitionBy("symbol", "_block").orderBy("bar_time"), horizons, windows, atr, zeros)
    return out.where(F.col("_block") == F.col("_own")).drop("_own", "_block")


def _both(bars: DataFrame, quotes: DataFrame, columns: list[str]) -> DataFrame:
    """Bars and quotes as one table: symbol, at, side (bars 0, quotes 1), bar, price, quote_volume."""
    carried = F.struct(*columns)
    left = bars.select("symbol", F.col("bar_time").alias("at"), F.lit(0).alias("side"), carried.alias("bar"), *[F.lit(None).cast(t).alias(c) for c, t in (("price", "double"), ("quote_volume", "double"))])
    right = quotes.select("symbol", F.col("quote_time").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(left.schema["bar"].dataType).alias("bar"), F.col("price").cast("double").alias("price"), F.col("quote_volume").cast("double").alias("quote_volume"))
    return left.unionByName(right)


def as_of(bars: DataFrame, quotes: DataFrame, columns: list[str]) -> DataFrame:
    """Each quote (symbol, quote_time, price, quote_volume) with the last bar at or before it.

    Both sides are one union ordered by time, bars first at equal times, and the last bar so far is carried along: one
    shuffle by symbol, no join whose size depends on how bars and quotes meet.
    """
    so_far = Window.partitionBy("symbol").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = _both(bars, quotes, columns).withColumn("bar", F.last("bar", ignorenulls=True).over(so_far)).where("side = 1")
    return held.select("symbol", F.col("at").alias("quote_time"), "price", "quote_volume", *[F.col(f"bar.`{c}`").alias(c) for c in columns])


def as_of_in_blocks(bars: DataFrame, quotes: DataFrame, columns: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """``as_of`` for symbols of any size: the last bar is carried along within buckets of time, and from bucket to bucket.

    What is carried between buckets is one bar each; a quote takes it where its own bucket has no bar before it. Quotes
    without a symbol or a time are left out.
    """
    both = _both(bars, quotes, columns).withColumn("_bucket", _bucket("at", bucket_seconds))
    last = both.groupBy("symbol", "_bucket").agg(F.max_by("bar", F.when(F.col("side") == 0, F.col("at"))).alias("_last"))
    earlier = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("symbol", "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy("symbol", "_bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("bar", F.last("bar", ignorenulls=True).over(so_far)).where("side = 1").join(carried, ["symbol", "_bucket"])
    held = held.withColumn("bar", F.coalesce("bar", "_carried"))
    return held.select("symbol", F.col("at").alias("quote_time"), "price", "quote_volume", *[F.col(f"bar.`{c}`").alias(c) for c in columns])


def features(bars: DataFrame, quotes: DataFrame, horizons: Iterable[int] = HORIZONS, windows: Iterable[int] = WINDOWS, atr: int = ATR, bucket_seconds: int | None = None, zeros: bool = False) -> DataFrame:
    """The feature vector of each quote, from the bars at or before it; one row per quote.

    With ``bucket_seconds``, symbols are split by time, as where one of them has a large share of all bars or quotes.
    A quote whose price is not positive has no features; with ``zeros`` prices and volumes are taken as they are, and
    what is divided by a price of 0 is infinite or NaN, as in SQL.
    """
    horizons, windows = list(horizons), list(windows)
    known = trailing_in_blocks(bars, horizons, windows, atr, bucket_seconds, zeros=zeros) if bucket_seconds else trailing(bars, horizons, windows, atr, zeros)
    passed = ["gap", "range", "close_location", f"average_true_range_{atr}", *[f"volatility_{n}" for n in windows]]
    wanted = ["bar_time", "bar_count", "mean_volume", *passed, *[f"close_{n}" for n in sorted({*horizons, 1, MOMENTUM})], *[f"{k}_{n}" for k in ("high", "low") for n in windows]]
    rows = as_of_in_blocks(known, quotes, wanted, bucket_seconds) if bucket_seconds else as_of(known, quotes, wanted)
    by_price = quotient if zeros else ratio
    price = F.col("price") if zeros else F.when(F.col("price") > 0, F.col("price"))
    volume = F.col("quote_volume") if zeros else F.when(price.isNotNull() & (F.col("quote_volume") >= 0), F.col("quote_volume"))
    back = lambda n: by_price(price, F.col(f"close_{n}")) - 1
    return rows.select(
        "symbol", "quote_time", F.coalesce("bar_count", F.lit(0)).cast("bigint").alias("bar_count"), price.alias("price"),
        *[back(n).alias(f"return_{n}") for n in horizons], *passed,
        *[(by_price(price, F.col(f"{k}_{n}")) - 1).alias(f"distance_to_{k}_{n}") for k in ("high", "low") for n in windows],
        back(MOMENTUM).alias("momentum"), (-back(1)).alias("short_term_reversal"),
        ratio(volume, F.col("mean_volume")).alias("volume_ratio"), (price * volume).alias("turnover"),
        (back(1) * ratio(volume, F.col("mean_volume"))).alias("price_volume_interaction"),
    )
