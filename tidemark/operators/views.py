"""What a dashboard shows: live movement, watchlist pages, focus ranking, portfolio values, audit projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import quotient, ratio

LOT = 100


def with_movement(forecasts: DataFrame, quotes: DataFrame, zeros: bool = False) -> DataFrame:
    """Forecasts (symbol, forecast, confidence, baseline, ...) with the live price, movement in percent and a status.

    From a baseline of 0 there is no movement; with ``zeros`` it is infinite or NaN, as in SQL.
    """
    rows = forecasts.join(quotes.select("symbol", F.col("price").alias("live"), *(["error"] if "error" in quotes.columns else [])), "symbol", "left")
    change = F.lit(100.0) * (F.col("live") - F.col("baseline"))
    move = quotient(change, F.col("baseline")) if zeros else ratio(change, F.col("baseline"))
    up, down = F.col("forecast") == "UP", F.col("forecast") == "DOWN"
    failed = F.col("error").isNotNull() if "error" in quotes.columns else F.lit(False)
    status = F.when(F.col("live").isNull(), F.when(failed, "Unavailable").otherwise("Pending")).when((up & (move > 0.1)) | (down & (move < -0.1)), "On track").when((up & (move < -0.1)) | (down & (move > 0.1)), "Counter")
    return rows.withColumns({"movement_pct": move, "status": status.when(F.col("forecast") == "FLAT", "In range").otherwise("Watching"), "tone": movement_tone(move)})


def movement_tone(move: Column) -> Column:
    return F.when(move.isNull(), "muted").when(move > 0.05, "positive").when(move < -0.05, "negative").otherwise("neutral")


def focus_score(confidence: Column, target_pct: Column, change_pct: Column) -> Column:
    points = F.when(confidence == "high", 45.0).when(confidence == "medium", 30.0).when(confidence == "low", 15.0)
    up = lambda x: F.greatest(x, F.lit(0.0))
    return points + F.least(up(target_pct) * 30, F.lit(100.0)) + F.least(up(change_pct) * 5, F.lit(25.0)) - up(change_pct - 4) * 10


def focus_risk(change_pct: Column) -> Column:
    return F.when(change_pct > 4, "Extended").when(change_pct > 2, "Watch").otherwise("Measured")


def focus(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k best UP forecasts by score, then target, then symbol, with their rank: a top-k report."""
    scored = rows.where("forecast = 'UP'").withColumn("score", focus_score(F.col("confidence"), F.col("target_return_pct"), F.col("baseline_change_pct")))
    best = scored.orderBy(F.desc("score"), F.desc("target_return_pct"), "symbol").limit(k)
    return best.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("score"), F.desc("target_return_pct"), "symbol")), "risk": focus_risk(F.col("baseline_change_pct"))})


SORTS = {
    "symbol": F.col, "baseline": F.col, "live": F.col, "movement_pct": F.col, "status": F.col,
    "forecast": lambda c: F.when(F.col(c) == "UP", 3).when(F.col(c) == "FLAT", 2).when(F.col(c) == "DOWN", 1),
    "confidence": lambda c: F.when(F.col(c) == "high", 3).when(F.col(c) == "medium", 2).when(F.col(c) == "low", 1),
}


def watchlist(rows: DataFrame, search: str = "", forecast: str | None = None, confidence: str | None = None, status: str | None = None, sort: str = "symbol", descending: bool = False, page: int = 1, page_size: int = 25) -> DataFrame:
    """One page of rows that fit the filters; null values sort below all others, symbols break ties."""
    for column, value in (("forecast", forecast), ("confidence", confidence), ("status", status)):
        rows = rows.where(F.col(column) == value) if value else rows
    rows = rows.where(F.contains("symbol", F.lit(search.strip().upper()))) if search.strip() else rows
    key = SORTS[sort](sort)
    ordered = rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "symbol")
    return ordered.offset((page - 1) * page_size).limit(page_size)


def portfolio(positions: DataFrame, quotes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Positions (keys, symbol, lots, average_cost) with value, profit and weight; the weight is null if any value is."""
    keys = keys or []
    rows = positions.join(quotes.select("symbol", "price"), "symbol", "left")
    shares = F.col("lots") * LOT
    rows = rows.withColumns({"shares": shares, "invested": shares * F.col("average_cost"), "value": shares * F.col("price")})
    total = whole(rows, keys).select(*keys, F.col("value").alias("total_value"))
    held = rows.join(total, keys, "left") if keys else rows.crossJoin(F.broadcast(total))
    return held.withColumns({"pnl": F.col("value") - F.col("invested"), "pnl_pct": F.lit(100.0) * ratio(F.col("value") - F.col("invested"), F.col("invested")), "weight_pct": F.lit(100.0) * ratio(F.col("value"), F.col("total_value"))}).drop("total_value")


def whole(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of valued positions; the value is null if that of any position is."""
    value = F.when(F.bool_and(F.col("value").isNotNull()), F.sum("value"))
    found = rows.groupBy(*keys).agg(F.sum("invested").alias("invested"), value.alias("value"))
    return found.withColumns({"pnl": F.col("value") - F.col("invested"), "pnl_pct": F.lit(100.0) * ratio(F.col("value") - F.col("invested"), F.col("invested"))})


AUDIT = ("symbol", "forecast", "confidence", "forecast_modifier", "sentiment_conflict", "baseline", "baseline_timestamp", "target_return_pct")


def audit(rows: DataFrame) -> DataFrame:
    """Only the columns that may be shown, whatever else a row holds."""
    return rows.select(*[c for c in AUDIT if c in rows.columns])


def audit_histograms(rows: DataFrame) -> DataFrame:
    """Rows by confidence and by forecast modifier in one pass: field, value, n."""
    fields = [c for c in ("confidence", "forecast_modifier", "forecast") if c in rows.columns]
    return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields]))).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def last_wins(feeds: list[DataFrame], key: str = "symbol") -> DataFrame:
    """Several feeds as one; of rows with the same key the last feed's wins."""
    whole_, columns = None, feeds[0].columns
    for i, f in enumerate(feeds):
        part = f.select(key, F.lit(i).alias("_ord"), F.struct(*columns).alias("r"))
        whole_ = part if whole_ is None else whole_.unionByName(part)
    return whole_.groupBy(key).agg(F.max_by("r", "_ord").alias("r")).select("r.*")
