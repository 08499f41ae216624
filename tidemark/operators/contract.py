"""The contract of archived snapshots, checked rule by rule on VARIANT documents; the trading calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import parse_time

# Fixed values of the snapshot format; the texts of violations below are part of it.
SCHEMA_VERSION, TIMEZONE = "1.0", "Asia/Jakarta"
HORIZONS = {"open": "open_to_break", "break": "break_to_close", "close": "close_to_next_open"}
FORECASTS = ("UP", "FLAT", "DOWN", "ABSTAIN")
MODIFIERS = ("supportive", "neutral", "mixed", "reduced_conviction", "market_headwind", "insufficient_data")
STATUSES = ("ok", "partial", "unavailable")
LAYERS = ("company", "sector", "indonesia_market", "global")
REQUIRED = ("schema_version", "snapshot_id", "created_at", "trading_date", "slot", "horizon", "timezone", "source", "immutable")
FLAGS = ("stale", "missing", "partial", "invalid", "thin_liquidity", "corporate_action_warning", "limit_move_warning", "suspension_warning")
METRICS = ("age_seconds", "delay_seconds", "turnover", "volume_ratio", "range_percent")


def _at(path: str, kind: str | None = None) -> Column:
    """What a path holds, as extracted by ``_extracted``, or as a ``kind`` where it can be one."""
    value = F.col(f"`{path}`")
    return F.try_variant_get(value, "$", kind) if kind else value


def _extracted(rows: DataFrame, doc: Column, paths: list[str], kept: list[str]) -> DataFrame:
    """Each path once, and its kind, so that the rules that ask about them look nothing up again.

    The kind is the first letter of the value as JSON: { [ " t f n, a digit or a minus; null where nothing is given.
    """
    held = rows.select(*kept, *[F.try_variant_get(doc, p, "variant").alias(p) for p in paths])
    return held.select("*", *[_kind_of(F.col(f"`{p}`")).alias(f"{p} kind") for p in paths])


def _kind_of(value: Column) -> Column:
    return F.left(F.to_json(value), F.lit(1))


def _is(path: str, kind: str) -> Column:
    """Whether a path holds an OBJECT, a STRING, a BOOLEAN or a NUMBER."""
    letters = {"OBJECT": "{", "STRING": '"', "BOOLEAN": "tf", "NUMBER": "-0123456789"}[kind]
    return F.coalesce(F.col(f"`{path} kind`").isin(*letters), F.lit(False))


def _given(path: str) -> Column:
    return _at(path).isNotNull()


def _null(path: str) -> Column:
    return F.coalesce(F.col(f"`{path} kind`") == "n", F.lit(True))


def _text(path: str) -> Column:
    """The string at a path; null if it is something else."""
    return F.when(_is(path, "STRING"), _at(path, "string"))


def _filled(path: str) -> Column:
    return F.coalesce(F.trim(_text(path)) != "", F.lit(False))


def _one_of(path: str, names) -> Column:
    return F.coalesce(_text(path).isin(*names), F.lit(False))


def _timed(path: str) -> Column:
    """Whether a path holds an ISO time with an offset."""
    t = _text(path)
    return F.coalesce(~t.rlike(r"^\s*[\d.]+\s*$") & parse_time(t).isNotNull(), F.lit(False))


def _rules(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in rules]))


_META = "$.archive_metadata"
_CONTEXTS = ("indonesia_market", "global")
HEADER_PATHS = [_META, *[f"{_META}.{k}" for k in REQUIRED], "$.market_context", *[f"$.market_context.{k}" for k in _CONTEXTS], "$.stocks"]


def _header() -> Column:
    m = lambda k: f"{_META}.{k}"
    slot = _text(m("slot"))
    horizon = F.try_element_at(F.create_map(*[F.lit(x) for p in HORIZONS.items() for x in p]), slot)
    known = _one_of(m("slot"), HORIZONS)
    date = _text(m("trading_date"))
    dated = F.coalesce(date.rlike(r"^\d{4}-\d{2}-\d{2}$") & date.try_cast("date").isNotNull(), F.lit(False))
    in_context = _is("$.market_context", "OBJECT")
    return _rules(
        (~_is(_META, "OBJECT"), "archive_metadata must be an object"),
        *[(~_given(m(k)), f"archive_metadata.{k} is required") for k in REQUIRED],
        (~_one_of(m("schema_version"), [SCHEMA_VERSION]), "archive_metadata.schema_version is unknown"),
        *[(_given(m(k)) & ~_filled(m(k)), f"archive_metadata.{k} must be a non-empty string") for k in ("snapshot_id", "source")],
        (_given(m("created_at")) & ~_timed(m("created_at")), "archive_metadata.created_at must be a time with an offset"),
        (~_null(m("trading_date")) & ~dated, "archive_metadata.trading_date must be a date"),
        (~known, "archive_metadata.slot is unknown"),
        (known & ~F.coalesce(_text(m("horizon")) == horizon, F.lit(False)), "archive_metadata.horizon does not fit the slot"),
        (~_one_of(m("timezone"), [TIMEZONE]), "archive_metadata.timezone is unknown"),
        (~F.coalesce(_is(m("immutable"), "BOOLEAN") & _at(m("immutable"), "boolean"), F.lit(False)), "archive_metadata.immutable must be true"),
        (~in_context, "market_context must be an object"),
        *[(in_context & ~_filled(f"$.market_context.{k}"), f"market_context.{k} must be a non-empty string") for k in _CONTEXTS],
        (~F.coalesce(F.size(_at("$.stocks", "array<variant>")) > 0, F.lit(False)), "stocks must be a non-empty array"),
    )


_Q = "$.data_quality"
STOCK_PATHS = [
    "$", "$.symbol", "$.forecast", *[f"$.probability_{c}" for c in ("up", "flat", "down")], "$.probabilities", *[f"$.probabilities.{c}" for c in ("UP", "FLAT", "DOWN")],
    "$.sentiment_context", *[f"$.sentiment_context.{k}" for k in LAYERS], "$.sentiment_conflict", "$.forecast_modifier", "$.sentiment_summary",
    _Q, *[f"{_Q}.{k}" for k in ("status", "issues", "observed_at", "valid_bar_count", *FLAGS, *METRICS)],
]


def _share(path: str) -> Column:
    return _given(path) & ~(_is(path, "NUMBER") & F.coalesce(_at(path, "double").between(0, 1), F.lit(False)))


def _stock() -> Column:
    has_q, has_c = _is(_Q, "OBJECT"), _is("$.sentiment_context", "OBJECT")
    issues = _at(f"{_Q}.issues", "array<variant>")
    sound = F.coalesce(F.forall(issues, lambda v: (_kind_of(v) == '"') & (F.trim(F.try_variant_get(v, "$", "string")) != "")), F.lit(False))
    unseen = _null(f"{_Q}.observed_at") & _one_of(f"{_Q}.status", ["unavailable"])
    count = f"{_Q}.valid_bar_count"
    object_ = _is("$", "OBJECT")
    return _rules(
        (~object_, "must be an object"),
        (object_ & ~_filled("$.symbol"), "symbol must be a non-empty string"),
        (F.col("repeats"), "symbol is a duplicate"),
        (_given("$.forecast") & ~_one_of("$.forecast", FORECASTS), "forecast is unknown"),
        *[(_share(f"$.probability_{c}"), f"probability_{c} must be a number from 0 to 1") for c in ("up", "flat", "down")],
        (_given("$.probabilities") & ~_is("$.probabilities", "OBJECT"), "probabilities must be an object"),
        *[(_share(f"$.probabilities.{c}"), f"probabilities.{c} must be a number from 0 to 1") for c in ("UP", "FLAT", "DOWN")],
        (~has_c, "sentiment_context must be an object"),
        *[(has_c & ~_filled(f"$.sentiment_context.{k}"), f"sentiment_context.{k} must be a non-empty string") for k in LAYERS],
        (~_is("$.sentiment_conflict", "BOOLEAN"), "sentiment_conflict must be a boolean"),
        (~_one_of("$.forecast_modifier", MODIFIERS), "forecast_modifier is unknown"),
        (~_filled("$.sentiment_summary"), "sentiment_summary must be a non-empty string"),
        (~has_q, "data_quality must be an object"),
        (has_q & ~_one_of(f"{_Q}.status", STATUSES), "data_quality.status is unknown"),
        (has_q & ~sound, "data_quality.issues must be an array of non-empty strings"),
        (has_q & ~unseen & ~_timed(f"{_Q}.observed_at"), "data_quality.observed_at must be a time with an offset"),
        *[(_given(f"{_Q}.{k}") & ~_is(f"{_Q}.{k}", "BOOLEAN"), f"data_quality.{k} must be a boolean") for k in FLAGS],
        (_given(count) & ~((F.schema_of_variant(_at(count)) == "BIGINT") & F.coalesce(_at(count, "bigint") >= 0, F.lit(False))), "data_quality.valid_bar_count must be a whole number from 0"),
        *[(~_null(f"{_Q}.{k}") & ~(_is(f"{_Q}.{k}", "NUMBER") & F.coalesce(_at(f"{_Q}.{k}", "double") >= 0, F.lit(False))), f"data_quality.{k} must be null or a number from 0") for k in METRICS],
    )


def violations(documents: DataFrame) -> DataFrame:
    """Every violation of every document (path, text): path, place (null, or the stock's index) and violation.

    All rules are looked at, so that one run names all that is wrong. A text that is no JSON object has one violation.
    Nothing is shuffled: a symbol repeats if it stands earlier in its own document's array.
    """
    doc = F.try_parse_json("text")
    usable = doc.isNotNull() & F.startswith(F.ltrim("text", F.lit(" \t\n\r")), F.lit("{"))
    docs = documents.select("path", doc.alias("doc"), usable.alias("usable"))
    heads = _extracted(docs, F.col("doc"), HEADER_PATHS, ["path", "usable"])
    found = F.when(F.col("usable"), _header()).otherwise(F.array(F.lit("root must be an object")))
    header = heads.select("path", F.lit(None).cast("int").alias("place"), F.explode(found).alias("violation"))

    array = docs.where("usable").select("path", F.try_variant_get("doc", "$.stocks", "array<variant>").alias("stocks"))
    text = lambda v: F.when(_kind_of(v) == '"', F.try_variant_get(v, "$", "string"))
    symbols = F.transform("stocks", lambda s: text(F.try_variant_get(s, "$.symbol", "variant")))
    each = array.select("path", symbols.alias("symbols"), F.posexplode("stocks").alias("place", "s"))
    symbol = F.get("symbols", F.col("place"))
    repeats = F.coalesce((F.trim(symbol) != "") & (F.array_position("symbols", symbol) - 1 < F.col("place")), F.lit(False))
    stocks = _extracted(each.select("path", "place", "s", repeats.alias("repeats")), F.col("s"), STOCK_PATHS, ["path", "place", "repeats"])
    return header.unionByName(stocks.select("path", "place", F.explode(_stock()).alias("violation")))


def trading_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """For each day: whether it is a trading day (no weekend, no holiday) and the next one after it, however far.

    Days of a run of closed days have one next trading day. Between the first and the last closed day the calendar is laid
    out once, one row a day; days after all holidays are reckoned from the weekday alone.
    """
    closed = holidays.select(F.col("day").alias("at"), F.lit(True).alias("closed")).distinct()
    span = holidays.agg(F.min("day").alias("low"), F.max("day").alias("high")).where("low is not null")
    laid = span.select(F.explode(F.sequence(F.col("low"), F.date_add("high", 7))).alias("at"))
    laid = laid.join(closed, "at", "left").select("at", (F.col("closed").isNull() & (F.weekday("at") < 5)).alias("open"))
    ahead = Window.orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    from_here = laid.select("at", "open", F.first(F.when(F.col("open"), F.col("at")), ignorenulls=True).over(ahead).alias("first_open"))
    weekday = F.weekday("day")
    tomorrow = F.date_add("day", F.when(weekday == 4, 3).when(weekday == 5, 2).otherwise(1))
    rows = days.withColumn("_after", tomorrow)
    rows = rows.join(from_here.select(F.col("at").alias("_after"), F.col("first_open").alias("_found")), "_after", "left")
    rows = rows.join(closed.withColumnRenamed("at", "day"), "day", "left")
    return rows.select("day", (F.col("closed").isNull() & (weekday < 5)).alias("is_trading_day"), F.coalesce("_found", "_after").alias("next_trading_day"))
