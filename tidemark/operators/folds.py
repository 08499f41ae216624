"""Chronological walk-forward folds: boundaries, purge and embargo, membership and predictors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import CLASSES, classify, finite, percent, round6
from .evaluation import classification_metrics, confusion, without_repeats

GROUP_FIELDS = ("horizon", "regime", "sector", "liquidity", "confidence")


@dataclass(frozen=True)
class FoldPlan:
    """Where folds lie. All spans are seconds; ``train_seconds`` limits the train span of either mode."""

    train_end: datetime
    validation_seconds: float
    test_seconds: float
    step_seconds: float | None = None
    mode: str = "expanding"
    train_seconds: float | None = None
    purge_seconds: float = 0
    embargo_seconds: float = 0
    fold_count: int | None = None

    def __post_init__(self):
        if self.mode not in ("expanding", "rolling"):
            raise ValueError("mode must be expanding or rolling")
        if self.mode == "rolling" and self.train_seconds is None:
            raise ValueError("a rolling train span needs train_seconds")
        for name in ("validation_seconds", "test_seconds", "step_seconds", "train_seconds"):
            if (v := getattr(self, name)) is not None and not v > 0:
                raise ValueError(f"{name} must be positive")
        if self.purge_seconds < 0 or self.embargo_seconds < 0:
            raise ValueError("purge and embargo must not be negative")
        if self.fold_count is not None and self.fold_count < 1:
            raise ValueError("fold_count must be positive")

    def boundaries(self, latest: datetime | None) -> list[tuple]:
        """(fold, train_start, train_cutoff, train_end, validation_end, test_start, test_end) until tests lie beyond ``latest``."""
        span, out, at = lambda s: timedelta(seconds=s), [], self.train_end
        while latest is not None and (self.fold_count is None or len(out) < self.fold_count):
            validation_end = at + span(self.validation_seconds)
            test_start = validation_end + span(self.embargo_seconds)
            if self.fold_count is None and test_start > latest:
                break
            start = at - span(self.train_seconds) if self.train_seconds is not None else None
            out.append((len(out), start, at - span(self.purge_seconds), at, validation_end, test_start, test_start + span(self.test_seconds)))
            at += span(self.step_seconds or self.test_seconds)
        return out


FOLDS = "fold int, train_start timestamp_ntz, train_cutoff timestamp_ntz, train_end timestamp_ntz, validation_end timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz"


def folds(spark: SparkSession, plan: FoldPlan, latest: datetime | None) -> DataFrame:
    """The boundaries as a table; as many rows as the plan has steps between its first and the latest time."""
    return spark.createDataFrame(plan.boundaries(latest), FOLDS)


def horizon_end(rows: DataFrame) -> Column:
    """When a row's outcome is known: horizon_end if given, else as_of and horizon_seconds, else as_of."""
    given = [F.col("horizon_end")] if "horizon_end" in rows.columns else []
    length = [F.col("as_of") + F.make_dt_interval(secs=F.col("horizon_seconds"))] if "horizon_seconds" in rows.columns else []
    return F.coalesce(*given, *length, F.col("as_of"))


def _run(at: Column, plan: FoldPlan, count: int, low_seconds: float | None, high_seconds: float) -> Column:
    """Folds whose boundary b has b + low_seconds <= at < b + high_seconds, as an array; without a low end, all later ones."""
    step = int((plan.step_seconds or plan.test_seconds) * 1e6)
    since = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.lit(plan.train_end).cast("timestamp_ntz").cast("timestamp"))
    low = F.greatest(F.floor((since - int(high_seconds * 1e6)) / step) + 1, F.lit(0)).cast("int")
    last = F.lit(count - 1)
    high = last if low_seconds is None else F.least(F.floor((since - int(low_seconds * 1e6)) / step), last)
    return F.when(low <= high, F.sequence(low, high.cast("int"))).otherwise(F.array().cast("array<int>"))


def membership(rows: DataFrame, plan: FoldPlan, latest: datetime | None, unique: Sequence[str] = ()) -> DataFrame:
    """Each row (as_of, horizon_end or horizon_seconds) in each fold it falls into: columns fold, split, kept.

    Train: before the boundary less the purge, and settled by the boundary. Validation: half-open, and settled by the
    test's start. Test: half-open. A row that lies in a span but is not settled in time has kept = false. Boundaries are
    evenly spaced, so a row's folds are reckoned from its time and exploded: nothing is joined or shuffled. Rows that repeat
    the columns ``unique``, such as id, or symbol and as_of, stop the evaluation; this check does shuffle.
    """
    rows = without_repeats(rows, *unique) if unique else rows
    count = len(plan.boundaries(latest))
    test = plan.validation_seconds + plan.embargo_seconds
    t = F.col("as_of")
    spans = {
        "train": (-plan.train_seconds if plan.train_seconds is not None else None, -plan.purge_seconds),
        "validation": (0, plan.validation_seconds),
        "test": (test, test + plan.test_seconds),
    }
    held = {split: _run(t, plan, count, *span) for split, span in spans.items()}
    named = lambda split: lambda i: F.struct(i.alias("fold"), F.lit(split).alias("split"))
    parts = [F.transform(found, named(split)) for split, found in held.items()]
    met = rows.withColumn("_end", horizon_end(rows)).where(t.isNotNull()).select("*", F.inline(F.concat(*parts)))
    step = F.make_dt_interval(secs=F.col("fold") * F.lit(float(plan.step_seconds or plan.test_seconds)))
    end = F.lit(plan.train_end).cast("timestamp_ntz") + step
    test_start = end + F.make_dt_interval(secs=F.lit(float(test)))
    kept = F.when(F.col("split") == "train", F.col("_end") <= end).when(F.col("split") == "validation", F.col("_end") <= test_start).otherwise(F.lit(True))
    return met.withColumn("kept", kept).select("fold", "split", "kept", *rows.columns)


def fold_counts(members: DataFrame) -> DataFrame:
    """Rows of each split of a fold, and the candidates that were purged."""
    of = lambda s, kept: F.count_if((F.col("split") == s) & (F.col("kept") == kept))
    return members.groupBy("fold").agg(
        of("train", True).alias("train_count"), of("validation", True).alias("validation_count"), of("test", True).alias("test_count"),
        of("train", False).alias("purged_train_count"), of("validation", False).alias("purged_validation_count"),
    )


def train_state(members: DataFrame) -> DataFrame:
    """What a fold's train rows say as a whole: the commonest class (ties to UP, FLAT, DOWN) and the last one's class."""
    train = members.where("split = 'train' and kept")
    counts = {c: F.count_if(F.col("actual") == c) for c in CLASSES}
    best = F.when((counts["UP"] >= counts["FLAT"]) & (counts["UP"] >= counts["DOWN"]), "UP").when(counts["FLAT"] >= counts["DOWN"], "FLAT").otherwise("DOWN")
    return train.groupBy("fold").agg(best.alias("majority"), F.max_by("actual", F.struct("as_of", "id")).alias("last_direction"), *[n.alias(f"{c.lower()}_count") for c, n in counts.items()])


def feature_votes(names: list[str], thresholds: dict[str, float] | None = None, decision: float = 0.0, known: Callable[[Column], Column] = finite) -> Column:
    """UP, FLAT or DOWN by the mean of the features' signs, each with its own dead band; null if a feature is missing (``known`` is null)."""
    limits = thresholds or {}
    if unknown := set(limits) - set(names):
        raise ValueError(f"thresholds for unknown features: {sorted(unknown)}")
    signs = []
    for n in names:
        v, limit = known(F.col(n)), float(limits.get(n, 0.0))
        signs.append(F.when(v > limit, 1).when(v < -limit, -1).when(v.isNotNull(), 0))
    return classify(sum(signs[1:], signs[0]) / len(signs), decision)


#: Names under which forecasts bring their class and their target, in order of precedence.
ALIASES = {"predicted": ("predicted", "direction", "class"), "predicted_target": ("predicted_target", "target", "value")}


def canonical_forecasts(rows: DataFrame) -> DataFrame:
    """Forecasts of any known layout with ``predicted`` (null unless one of the classes) and ``predicted_target``."""
    def first(name):
        given = [F.col(c).cast("string" if name == "predicted" else "double") for c in ALIASES[name] if c in rows.columns]
        return F.coalesce(*given) if given else F.lit(None).cast("string" if name == "predicted" else "double")

    said = first("predicted")
    others = [c for c in rows.columns if c not in {a for names in ALIASES.values() for a in names}]
    return rows.select(*others, F.when(said.isin(*CLASSES), said).alias("predicted"), finite(first("predicted_target")).alias("predicted_target"))


Predictor = Callable[[DataFrame, DataFrame], DataFrame]


def predicted(members: DataFrame, predictor: str | Predictor, splits: tuple[str, ...] = ("validation", "test"), **options) -> DataFrame:
    """Rows of the splits with ``predicted``: always_flat, majority_train, previous_direction or feature_sign.

    A function takes (train rows, rows to predict), both with their fold, and returns the latter with ``predicted`` or
    another name of it; it is one query over all folds, and sees no outcome of the rows it predicts.
    """
    if not splits or set(splits) - {"validation", "test"}:
        raise ValueError("splits are validation and test")
    rows = members.where(F.col("split").isin(*splits) & F.col("kept"))
    if callable(predictor):
        hidden = [c for c in ("actual", "target", "actual_target") if c in rows.columns]
        said = canonical_forecasts(predictor(members.where("split = 'train' and kept"), rows.drop(*hidden)))
        return said.drop(*hidden).join(rows.select("fold", "split", "id", *hidden), ["fold", "split", "id"])
    if predictor == "always_flat":
        return rows.withColumn("predicted", F.lit("FLAT"))
    if predictor == "feature_sign":
        return rows.withColumn("predicted", feature_votes(options["features"], options.get("thresholds"), options.get("decision", 0.0), options.get("known", finite)))
    column = {"majority_train": "majority", "previous_direction": "last_direction"}[predictor]
    state = train_state(members).select("fold", F.col(column).alias("said"))
    return rows.join(F.broadcast(state), "fold", "left").withColumn("predicted", F.coalesce("said", F.lit("FLAT"))).drop("said")


def fold_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Eligible and predicted rows, coverage and metrics by key; a null prediction is not covered, and not wrong."""
    cells = confusion(rows, keys)
    base = classification_metrics(cells, [*keys, "rows_in"])
    return base.withColumnRenamed("rows_in", "eligible").withColumn("coverage_pct", percent(F.col("evaluated"), F.col("eligible")))


def grouped_metrics(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Metrics by each of several fields, one at a time, in one pass: columns field and value. Rows without one are 'None'."""
    value = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("None"))
    one = F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields])
    return fold_metrics(rows.select("actual", "predicted", F.inline(one)), ["field", "value"])


def target_error(rows: DataFrame, keys: list[str]) -> DataFrame:
    both = F.abs(F.col("predicted_target") - F.col("actual_target"))
    return rows.groupBy(*keys).agg(round6(F.avg(both)).alias("target_mae"), F.count(both).alias("target_evaluated"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has; an evaluation takes rows only where this is empty."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")

