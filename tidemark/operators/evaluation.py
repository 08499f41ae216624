"""Three-way forecasts against what happened: rows, confusion cells, metrics, naive baselines and pair reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.values import CLASSES, classify, percent, ratio, round6

#: Which checkpoint settles a forecast made at each slot, and the names that older documents use.
NEXT_SLOT = {"open": "break", "break": "close", "close": "open"}
SLOT_NAMES = {"open": "open", "break": "break", "close": "close", "open_0901_wib": "open", "break_1201_wib": "break", "close_1601_wib": "close"}


def slot_of(raw: Column) -> Column:
    """The slot by any of its names, or null."""
    names = F.create_map(*[F.lit(x) for pair in SLOT_NAMES.items() for x in pair])
    return F.try_element_at(names, raw)


def next_slot(slot: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in NEXT_SLOT.items() for x in pair]), slot)


def check_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (pair, slot, checkpoint_slot, threshold_pct) that can't be evaluated, with the reason; empty if all can."""
    wrong = F.when(F.col("slot").isNull(), "unknown_slot").when(~F.col("checkpoint_slot").eqNullSafe(next_slot(F.col("slot"))), "wrong_checkpoint")
    wrong = wrong.when(F.col("threshold_pct").isNull(), "missing_threshold").when(F.col("threshold_pct") < 0, "negative_threshold")
    return pairs.select("pair", wrong.alias("reason")).where("reason is not null")


def market_class(pairs: DataFrame) -> DataFrame:
    """pair, market_direction: class of the benchmark's return where both snapshots name the same benchmark."""
    same = (F.col("benchmark") == F.col("checkpoint_benchmark")) & (F.col("benchmark_price") != 0)
    change = F.when(same, (ratio(F.col("checkpoint_benchmark_price"), F.col("benchmark_price")) - 1) * 100)
    return pairs.select("pair", classify(change, F.col("threshold_pct")).alias("market_direction"))


def without_repeats(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, whose reading stops with an error, naming the keys, if two have the same ``keys``; nulls are a key like others.

    The check is a count within the partitions that a join or grouping by the keys needs anyway, in the pass that reads the rows.
    """
    times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    named = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    stop = F.raise_error(F.concat(F.lit(f"repeated {', '.join(keys)}: "), named))
    return rows.withColumn("_times", times).where(F.when(F.col("_times") > 1, stop.cast("boolean")).otherwise(F.lit(True))).drop("_times")


def counted(rows: DataFrame, observation: Observation, rejected: Column) -> DataFrame:
    """``rows`` that are not ``rejected``, whose numbers (eligible, rejected, evaluated) the ``observation`` has after any pass over them.

    The counts are made while the rows are read, without a job of their own.
    """
    is_bad = F.coalesce(rejected, F.lit(True))
    told = rows.withColumn("_bad", is_bad).observe(observation, F.count(F.lit(1)).alias("eligible"), F.count_if("_bad").alias("rejected"), F.count_if(~F.col("_bad")).alias("evaluated"))
    return told.where(~F.col("_bad")).drop("_bad")


def settled(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each forecast (pair, symbol, forecast, baseline, target_return_pct, threshold_pct) with its outcome's price.

    A symbol that a pair or its checkpoint has twice stops the evaluation.

    state is missing (no outcome row), invalid (no class of the three, no positive baseline, no price or no target; an
    abstention is invalid) or evaluated.
    """
    right = outcomes.select("pair", "symbol", F.col("baseline").alias("realized_price"), F.lit(True).alias("found"))
    forecasts, right = without_repeats(forecasts, "pair", "symbol"), without_repeats(right, "pair", "symbol")
    rows = forecasts.join(right, ["pair", "symbol"], "left")
    good = F.coalesce(F.col("forecast").isin(*CLASSES) & (F.col("baseline") > 0) & F.col("realized_price").isNotNull() & F.col("target_return_pct").isNotNull(), F.lit(False))
    state = F.when(F.col("found").isNull(), "missing").when(~good, "invalid").otherwise("evaluated")
    realized = F.when(state == "evaluated", (ratio(F.col("realized_price"), F.col("baseline")) - 1) * 100)
    return rows.select(
        "pair", "symbol", "forecast", "target_return_pct", state.alias("state"), realized.alias("realized_return_pct"),
        classify(realized, F.col("threshold_pct")).alias("actual"), F.abs(F.col("target_return_pct") - realized).alias("target_absolute_error_pct"),
    )


def confusion(rows: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Counts of each (actual, predicted) as nine columns, zeros included; at most one row per key and task is shuffled."""
    cells = [F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(f"{a}_{p}") for a in CLASSES for p in CLASSES]
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(*cells, F.count(F.lit(1)).alias("rows_in"))


def classification_metrics(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and each class' support, precision and recall, in percent to 6 places.

    Balanced accuracy is the mean recall of classes that occur, macro F1 the mean over classes that occur or are
    predicted. A share of nothing is null.
    """
    c = lambda a, p: F.col(f"{a}_{p}")
    support = {a: sum((c(a, p) for p in CLASSES[1:]), c(a, CLASSES[0])) for a in CLASSES}
    predicted = {p: sum((c(a, p) for a in CLASSES[1:]), c(CLASSES[0], p)) for p in CLASSES}
    n = sum((support[a] for a in CLASSES[1:]), support[CLASSES[0]])
    correct = sum((c(a, a) for a in CLASSES[1:]), c(CLASSES[0], CLASSES[0]))
    recalls = {a: ratio(c(a, a), support[a]) for a in CLASSES}
    f1s = {a: ratio(2 * c(a, a), support[a] + predicted[a]) for a in CLASSES}

    def mean(values):
        held = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
        return round6(F.lit(100.0) * ratio(held, sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values[1:]), F.when(values[0].isNotNull(), 1).otherwise(0))))

    out = [n.alias("evaluated"), percent(correct, n).alias("accuracy_pct"), mean(list(recalls.values())).alias("balanced_accuracy_pct"), mean(list(f1s.values())).alias("macro_f1_pct")]
    for a in CLASSES:
        low = a.lower()
        out += [support[a].alias(f"{low}_support"), percent(c(a, a), predicted[a]).alias(f"{low}_precision_pct"), percent(c(a, a), support[a]).alias(f"{low}_recall_pct")]
    return cells.select(*keys, *out)


def with_baselines(rows: DataFrame) -> DataFrame:
    """Evaluated rows once for each way to predict: the forecast, always FLAT, and the market's class where it is known."""
    ways = F.array(
        F.struct(F.lit("forecast").alias("way"), F.col("forecast").alias("predicted")),
        F.struct(F.lit("always_flat").alias("way"), F.lit("FLAT").alias("predicted")),
        F.struct(F.lit("market_direction").alias("way"), F.col("market_direction").alias("predicted")),
    )
    return rows.where("state = 'evaluated'").select("pair", "actual", F.inline(ways)).where("predicted is not null")


def pair_reports(rows: DataFrame) -> DataFrame:
    """For each pair: counts, missing and invalid symbols in order, and whether all forecasts are settled."""
    names = lambda s: F.sort_array(F.collect_list(F.when(F.col("state") == s, F.col("symbol"))))
    found = rows.groupBy("pair").agg(
        F.count(F.lit(1)).alias("total_forecasts"), F.count_if(F.col("state") == "evaluated").alias("evaluated"),
        names("missing").alias("missing_symbols"), names("invalid").alias("invalid_symbols"), round6(F.avg("target_absolute_error_pct")).alias("target_mae_pct"),
    )
    done = F.when(F.col("evaluated") == F.col("total_forecasts"), "complete").otherwise("pending")
    return found.withColumns({"status": done, "coverage_pct": percent(F.col("evaluated"), F.col("total_forecasts"))})
