"""Calibration of three-way probabilities: one-vs-rest logistic curves, temperature, proper scores and reliability."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import CLASSES, clip, finite, likeliest, logit, percent, ratio, sigmoid, softmax, valid_probabilities
from ..sources.shared import checkpointed
from . import models
from .descent import Share, fit_by_key

P = ("p_up", "p_flat", "p_down")


def _curves(share: Share, x: np.ndarray, y: np.ndarray, n: np.ndarray, iterations: int, rate: float, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope and intercept of a logistic curve for each key and class, by full-batch steps from slope 0 and the smoothed prevalence.

    ``n``: the rows that each entry stands for. Also returns the number of rows of each key and of each of its classes.
    """
    sums = share.total(lambda _, s: np.append(n[s] @ y[s], n[s].sum()))
    rows, of_class = sums[:, -1:], sums[:, :-1]
    a, b = np.zeros_like(of_class), np.log((of_class + 0.5) / (rows - of_class + 0.5))

    def gradient(i: int, s: slice) -> np.ndarray:
        error = n[s, None] * (0.5 * (1 + np.tanh((b[i] + a[i] * x[s]) / 2)) - y[s])
        return np.stack([(error * x[s]).sum(0), error.sum(0)])

    for _ in range(iterations):
        g = share.total(gradient) / np.maximum(rows, 1)[:, None]
        a, b = a - rate * (g[:, 0] + penalty * a), b - rate * g[:, 1]
    return a, b, sums


def _temperatures(share: Share, z: np.ndarray, y: np.ndarray, n: np.ndarray, rows: np.ndarray, iterations: int, rate: float) -> np.ndarray:
    """A temperature of the log probabilities ``z`` for each key, by steps on its logarithm, kept within 0.01 and 100."""
    at = np.zeros(len(rows))

    def gradient(i: int, s: slice) -> np.ndarray:
        warm = z[s] / np.exp(at[i])
        w = np.exp(warm - warm.max(1, keepdims=True, initial=-np.inf))
        return np.array([(n[s, None] * (y[s] - w / w.sum(1, keepdims=True)) * z[s]).sum()])

    for _ in range(iterations):
        at = np.clip(at - rate * share.total(gradient)[:, 0] / np.maximum(rows, 1) / np.exp(at), np.log(0.01), np.log(100))
    return np.exp(at)


def _weighted(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Equal rows as one with their number, and the columns of a fit: logits, classes, and a number that is 0 for invalid rows.

    Invalid rows are told apart in the columns: as a filter, the test would be pushed below a model's scores and compute them
    many times over.
    """
    held = rows.groupBy(*keys, *P, "actual").agg(F.count(F.lit(1)).alias("n"))
    ok = valid_probabilities(*[F.col(c) for c in P]) & F.coalesce(F.col("actual").isin(*CLASSES), F.lit(False))
    columns = {f"x{k}": F.when(ok, logit(F.col(c))).otherwise(0.0) for k, c in enumerate(P)} | {f"y{k}": ok & (F.col("actual") == c) for k, c in enumerate(CLASSES)}
    return held, columns | {"n": F.when(ok, F.col("n")).otherwise(0)}


def _arrays(share: Share) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stack = lambda c: np.stack([share.values[f"{c}{k}"] for k in range(len(CLASSES))], 1).astype(float)
    return stack("x"), np.nan_to_num(stack("y")), share.values["n"].astype(float)


def fit(rows: DataFrame, keys: list[str], iterations: int = 500, rate: float = 0.05, penalty: float = 0.0, with_temperature: bool = True, tasks: int | None = None) -> DataFrame:
    """A calibrator for each key (such as fold and horizon) from all its rows (p_up, p_flat, p_down, actual), in one job.

    Rows with invalid vectors or classes are left out; a key without valid rows has no calibrator. Equal rows are one row
    with their number; tasks sum the gradients of what they hold among themselves (``descent``).
    """
    if rate <= 0 or penalty < 0:
        raise ValueError("the rate must be positive and the penalty not negative")

    def program(share: Share) -> list[dict | None]:
        x, y, n = _arrays(share)
        a, b, sums = _curves(share, x, y, n, iterations, rate, penalty)
        raw = np.empty_like(x)
        for i, s in enumerate(share.slices):
            raw[s] = 0.5 * (1 + np.tanh((b[i] + a[i] * x[s]) / 2))
        z = np.log(np.clip(raw / raw.sum(1, keepdims=True), 1e-12, 1 - 1e-12))
        t = _temperatures(share, z, y, n, sums[:, -1], iterations, rate) if with_temperature else np.ones(len(a))
        return [{"slopes": a[i].tolist(), "shifts": b[i].tolist(), "temperature": float(t[i]), "fitted_rows": int(sums[i, -1])} if sums[i, -1] else None for i in range(len(a))]

    return fit_by_key(*_in(rows, keys), program, "slopes array<double>, shifts array<double>, temperature double, fitted_rows bigint", tasks)


def coefficients(rows: DataFrame, keys: list[str], iterations: int = 1000, rate: float = 0.03, tasks: int | None = None) -> DataFrame:
    """Each class' calibration slope and intercept: its logistic curve fitted anew to the judged rows, by key.

    1 and 0 say that probabilities are as the outcomes. Null for a class that all valid rows of a key have, or none.
    """

    def program(share: Share) -> list[dict | None]:
        a, b, sums = _curves(share, *_arrays(share), iterations, rate, 0.0)
        out = []
        for i in range(len(a)):
            told = {}
            for k, c in enumerate(CLASSES):
                both = 0 < sums[i, k] < sums[i, -1]
                told |= {f"{c.lower()}_slope": float(a[i, k]) if both else None, f"{c.lower()}_intercept": float(b[i, k]) if both else None}
            out.append(told)
        return out

    return fit_by_key(*_in(rows.withColumn("actual", F.upper("actual")), keys), program, ", ".join(f"{c.lower()}_{v} double" for c in CLASSES for v in ("slope", "intercept")), tasks)


def _in(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], dict[str, Column]]:
    held, columns = _weighted(rows, keys)
    return held, keys, columns


def apply(rows: DataFrame, calibrators: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with calibrated probabilities, decision and reason; ABSTAIN without a valid vector or a calibrator."""
    ok = valid_probabilities(*[F.col(c) for c in P])
    held = rows.join(calibrators, keys, "left")
    raw = [sigmoid(F.get("shifts", F.lit(k)) + F.get("slopes", F.lit(k)) * logit(F.col(c))) for k, c in enumerate(P)]
    held = held.withColumns({f"_r{k}": v for k, v in enumerate(raw)})
    total = F.col("_r0") + F.col("_r1") + F.col("_r2")
    reason = F.when(~ok, "invalid_probabilities").when(F.col("slopes").isNull(), "calibrator_unavailable_for_horizon").when(~F.coalesce(total > 0, F.lit(False)), "invalid_calibrated_probabilities")
    held = held.withColumn("reason", reason)
    shares = [ratio(F.col(f"_r{k}"), total) for k in range(3)]
    warm = softmax(*[F.log(clip(s)) / F.col("temperature") for s in shares])
    held = held.withColumns({f"c_{c[2:]}": F.when(F.col("reason").isNull(), F.when(F.col("temperature") == 1.0, shares[k]).otherwise(warm[k])) for k, c in enumerate(P)})
    decision = F.when(F.col("reason").isNotNull(), "ABSTAIN").otherwise(likeliest(F.col("c_up"), F.col("c_flat"), F.col("c_down")))
    return held.withColumn("decision", decision).drop("_r0", "_r1", "_r2", "slopes", "shifts", "temperature", "fitted_rows")


def to_documents(calibrators: DataFrame) -> DataFrame:
    """Fitted calibrators as JSON texts of their own kind and version."""
    return models.to_documents(calibrators, "calibrator")


def from_documents(documents: DataFrame, keys: str) -> DataFrame:
    """Calibrators from JSON texts, by the ``keys`` of this DDL; only whole ones: three finite slopes and shifts and a temperature above 0."""
    found = models.from_documents(documents, "calibrator", f"{keys}, slopes array<double>, shifts array<double>, temperature double, fitted_rows bigint")
    whole = lambda c: (F.size(c) == len(CLASSES)) & F.forall(c, lambda v: finite(v).isNotNull())
    return found.where(whole("slopes") & whole("shifts") & (finite(F.col("temperature")) > 0))


def fit_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the rows given to a fit, those that it takes, and those that it rejects."""
    ok = valid_probabilities(*[F.col(c) for c in P]) & F.coalesce(F.col("actual").isin(*CLASSES), F.lit(False))
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("eligible_rows"), F.count_if(ok).alias("fitted_rows"))
    return found.withColumn("rejected_rows", F.col("eligible_rows") - F.col("fitted_rows"))


def report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``scores`` of judged rows beside each class' calibration slope and intercept, refitted on them, by key."""
    judged = checkpointed(rows)
    return scores(judged, keys).join(coefficients(judged, keys), keys, "left") if keys else scores(judged, keys).join(coefficients(judged, keys), how="left")


def row_probabilities(rows: DataFrame, field: str = "probabilities") -> DataFrame:
    """Rows with p_up, p_flat and p_down from ``field``, a struct or map of UP, FLAT and DOWN.

    Where ``probabilities`` itself is asked for and a row has none, those inside its ``prediction`` are taken instead.
    """
    given = [F.col(field)] if field in rows.columns else []
    if field == "probabilities" and "prediction" in rows.columns:
        given.append(F.col("prediction.probabilities"))
    if not given:
        raise ValueError(f"rows have no {field}")
    found = F.coalesce(*given)
    return rows.withColumns({p: found[c].cast("double") for p, c in zip(P, CLASSES, strict=True)})


def sourced(members: DataFrame, source: Callable[[DataFrame, DataFrame], DataFrame], splits: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """Rows of the splits with the probabilities that a function gives them from (train rows, rows without outcomes)."""
    rows = members.where(F.col("split").isin(*splits) & F.col("kept"))
    hidden = [c for c in ("actual", "target", "actual_target") if c in rows.columns]
    out = source(members.where("split = 'train' and kept"), rows.drop(*hidden))
    if missing := set(P) - set(out.columns):
        raise ValueError(f"a source of probabilities must give {sorted(missing)}")
    return out.join(rows.select("fold", "split", "id", *hidden), ["fold", "split", "id"])


def _judged(rows: DataFrame) -> DataFrame:
    ok = valid_probabilities(*[F.col(c) for c in P]) & F.coalesce(F.upper("actual").isin(*CLASSES), F.lit(False))
    top = F.greatest(*P)
    return rows.withColumns({"ok": ok, "actual": F.upper("actual"), "confidence": top, "hit": (likeliest(*[F.col(c) for c in P]) == F.upper("actual")).cast("double")})


def scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Brier score and log loss, multiclass and by class, with coverage: all in one aggregate."""
    r = _judged(rows)
    p, y = {c: F.col(f"p_{c.lower()}") for c in CLASSES}, {c: (F.col("actual") == c).cast("double") for c in CLASSES}
    ok = F.col("ok")
    square = {c: (p[c] - y[c]) * (p[c] - y[c]) for c in CLASSES}
    own = F.when(F.col("actual") == "UP", p["UP"]).when(F.col("actual") == "FLAT", p["FLAT"]).otherwise(p["DOWN"])
    binary = {c: -(y[c] * F.log(clip(p[c])) + (1 - y[c]) * F.log(clip(1 - p[c]))) for c in CLASSES}
    mean = lambda v: F.avg(F.when(ok, v))
    found = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(ok).alias("evaluated"), mean(square["UP"] + square["FLAT"] + square["DOWN"]).alias("brier_score"), mean(-F.log(clip(own))).alias("log_loss"),
        *[mean(square[c]).alias(f"{c.lower()}_brier") for c in CLASSES], *[mean(binary[c]).alias(f"{c.lower()}_log_loss") for c in CLASSES], *[F.count_if(ok & (F.col("actual") == c)).alias(f"{c.lower()}_support") for c in CLASSES],
    )
    return found.withColumns({"rejected": F.col("eligible") - F.col("evaluated"), "coverage_pct": percent(F.col("evaluated"), F.col("eligible"))})


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins of the top probability, empty ones too; the last one holds 1. count, mean_confidence, accuracy.

    A row's bin is looked up among the edges i / bins themselves, so that a value on an edge falls as the edges say.
    """
    if bins < 1:
        raise ValueError("bins must be positive")
    edges = [F.lit(i / bins) for i in range(1, bins)]
    place = F.size(F.filter(F.array(*edges), lambda e: e <= F.col("confidence"))) if edges else F.lit(0)
    found = _judged(rows).where("ok").groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("hit").alias("accuracy"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("lower"), ((F.col("id") + 1) / bins).alias("upper"))
    return grid.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error over reliability bins."""
    return bins.agg(ratio(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))), F.sum("n")).alias("expected_calibration_error"))
