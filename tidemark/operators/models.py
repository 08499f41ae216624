"""Transparent models, fitted on train rows of each fold: class shares, standardiser, ridge, and multinomial logistic.

Everything that is a sum is one grouped aggregate. The logistic fit is full-batch gradient descent, whose iterates are
the definition of its result; it is one barrier stage over all train rows (``descent``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import CLASSES, classify, finite, likeliest, ratio, softmax
from .descent import Share, fit_by_key


#: Which values a model takes: null is missing. Those that aren't finite make NaN of all that they go into.
Known = Callable[[Column], Column]


def vector(names: list[str], known: Known = finite) -> Column:
    """The features as array<double>, null if any is missing: by default, null or not finite."""
    values = [known(F.col(n)) for n in names]
    ok = values[0].isNotNull()
    for v in values[1:]:
        ok = ok & v.isNotNull()
    return F.when(ok, F.array(*values))


def class_shares(train: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of the classes, and the commonest one (ties to UP, FLAT, DOWN)."""
    n = {c: F.count_if(F.col("actual") == c) for c in CLASSES}
    found = train.groupBy(*keys).agg(*[v.alias(f"{c.lower()}_count") for c, v in n.items()])
    up, flat, down = (F.col(f"{c.lower()}_count") for c in CLASSES)
    return found.withColumns({f"p_{c.lower()}": ratio(F.col(f"{c.lower()}_count"), up + flat + down) for c in CLASSES} | {"direction": likeliest(up, flat, down)})


def standardiser(train: DataFrame, names: list[str], keys: list[str], known: Known = finite) -> DataFrame:
    """Mean and population deviation of each feature over rows where all are known; a deviation of 0 becomes 1."""
    rows = train.withColumn("_vector", vector(names, known)).where("_vector is not null")
    sd = lambda n: F.stddev_pop(n)
    return rows.groupBy(*keys).agg(*[F.avg(n).alias(f"mean_{n}") for n in names], *[F.when(sd(n) > 0, sd(n)).otherwise(1.0).alias(f"scale_{n}") for n in names], F.count(F.lit(1)).alias("row_count"))


def ridge_sums(train: DataFrame, names: list[str], keys: list[str], target: str, known: Known = finite) -> DataFrame:
    """All sums that normal equations need, in one pass: products of features, features with the target, and plain sums."""
    rows = train.withColumn("_vector", vector(names, known)).where(F.col("_vector").isNotNull() & known(F.col(target)).isNotNull())
    d = len(names)
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"xx_{i}_{j}") for i in range(d) for j in range(i, d)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("y"), *[F.sum(c).alias(f"x_{i}") for i, c in enumerate(names)], *[F.sum(F.col(c) * F.col(target)).alias(f"xy_{i}") for i, c in enumerate(names)], *products)


def _nan_again(values: Column, depth: int) -> Column:
    """Numbers, in lists of so many levels, whose NaN pandas has handed on as null."""
    return F.transform(values, lambda v: _nan_again(v, depth - 1)) if depth else F.coalesce(values, F.lit(float("nan")))


def _solved(r: dict, d: int, penalty: float) -> dict:
    n = r["n"]
    mean = np.array([r[f"x_{i}"] for i in range(d)], float) / n
    with np.errstate(invalid="ignore"):  # of infinite values
        xx = np.array([[r[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float) - n * np.outer(mean, mean)
        var = np.maximum(np.diag(xx) / n, 0)
        scale = np.where(np.isnan(var) | (var > 1e-18), np.sqrt(var), 1.0)
        xy = (np.array([r[f"xy_{i}"] for i in range(d)], float) - mean * r["y"]) / scale
    b = np.full(d, np.nan)  # infinite values have no covariance
    if np.isfinite(xx).all() and np.isfinite(xy).all():
        b = np.linalg.solve(xx / np.outer(scale, scale) + penalty * n * np.eye(d), xy)
    return {"means": mean.tolist(), "scales": scale.tolist(), "coefficients": b.tolist(), "intercept": r["y"] / n, "row_count": n}


def solved(sums: DataFrame, d: int, keys: list[str], penalty: float) -> DataFrame:
    """Ridge models from the sums of ``ridge_sums``: d equations for each key, a small task over one row of sums."""

    def solve(frames):
        for f in frames:
            out = [{**{k: r[k] for k in keys}, **_solved(r, d, penalty)} for r in f.to_dict("records")]
            yield pd.DataFrame(out, columns=[*keys, "means", "scales", "coefficients", "intercept", "row_count"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in keys)
    found = sums.mapInPandas(solve, f"{head}{', ' if head else ''}means array<double>, scales array<double>, coefficients array<double>, intercept double, row_count bigint")
    return found.withColumns({c: _nan_again(F.col(c), depth) for c, depth in (("means", 1), ("scales", 1), ("coefficients", 1), ("intercept", 0))})


def ridge(train: DataFrame, names: list[str], keys: list[str], target: str = "target", penalty: float = 0.01, known: Known = finite) -> DataFrame:
    """Standardised ridge coefficients of each key: means, scales, coefficients, intercept, row_count; one aggregate makes the sums."""
    return solved(ridge_sums(train, names, keys, target, known), len(names), keys, penalty)


def standardised(x: Column) -> Column:
    return F.transform(F.arrays_zip(x.alias("x"), F.col("means").alias("m"), F.col("scales").alias("s")), lambda z: (z["x"] - z["m"]) / z["s"])


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def score_ridge(rows: DataFrame, models: DataFrame, names: list[str], keys: list[str], decision: float = 0.0, known: Known = finite) -> DataFrame:
    """Rows with predicted_target and predicted; null where a feature is missing or there is no model."""
    held = rows.join(models, keys, "left")
    guess = F.col("intercept") + dot(standardised(vector(names, known)), F.col("coefficients"))
    return held.withColumn("predicted_target", guess).withColumn("predicted", classify(F.col("predicted_target"), decision)).drop("means", "scales", "coefficients", "intercept", "row_count")


def logistic(train: DataFrame, names: list[str], key: str = "fold", penalty: float = 0.01, iterations: int = 500, rate: float = 0.1, tasks: int | None = None, known: Known = finite) -> DataFrame:
    """Multinomial logistic models by key, on standardised features: full-batch steps from zero over all train rows.

    One job, in which tasks sum gradients among themselves (``descent``): first the features' sums and squares about their
    means, then one step after another. The penalty is on weights, not on intercepts.
    """
    if rate <= 0 or penalty < 0:
        raise ValueError("the rate must be positive and the penalty not negative")
    rows = train.withColumn("_vector", vector(names, known)).where(F.col("_vector").isNotNull() & F.col("actual").isin(*CLASSES))
    columns = {f"x{i}": F.get("_vector", F.lit(i)) for i in range(len(names))} | {f"y{k}": F.col("actual") == c for k, c in enumerate(CLASSES)}

    def program(share: Share) -> list[dict]:
        x = np.stack([share.values[f"x{i}"] for i in range(len(names))], 1).astype(float)
        y = np.stack([share.values[f"y{k}"] for k in range(len(CLASSES))], 1).astype(float)
        sums = share.total(lambda _, s: np.append(x[s].sum(0), s.stop - s.start))
        n, mean = sums[:, -1], sums[:, :-1] / sums[:, -1:]
        spread = np.sqrt(share.total(lambda i, s: ((x[s] - mean[i]) ** 2).sum(0)) / n[:, None])
        scale = np.where(np.isnan(spread) | (spread > 1e-13 * np.abs(mean)), spread, 1.0)
        for i, s in enumerate(share.slices):
            x[s] = (x[s] - mean[i]) / scale[i]
        w, b = np.zeros((len(n), len(CLASSES), len(names))), np.zeros((len(n), len(CLASSES)))

        def gradient(i: int, s: slice) -> np.ndarray:
            z = x[s] @ w[i].T + b[i]
            p = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
            error = p / p.sum(1, keepdims=True) - y[s]
            return np.concatenate([error.T @ x[s], error.sum(0)[:, None]], 1)

        for _ in range(iterations):
            g = share.total(gradient) / n[:, None, None]
            w, b = w - rate * (g[:, :, :-1] + penalty * w), b - rate * g[:, :, -1]
        return [{"means": mean[i].tolist(), "scales": scale[i].tolist(), "coefficients": w[i].tolist(), "intercepts": b[i].tolist(), "row_count": int(n[i])} for i in range(len(n))]

    def descend(share: Share) -> list[dict]:
        with np.errstate(invalid="ignore"):  # of infinite values
            return program(share)

    schema = "means array<double>, scales array<double>, coefficients array<array<double>>, intercepts array<double>, row_count bigint"
    found = fit_by_key(rows, [key], columns, descend, schema, tasks)
    return found.withColumns({c: _nan_again(F.col(c), depth) for c, depth in (("means", 1), ("scales", 1), ("coefficients", 2), ("intercepts", 1))})


def score_logistic(rows: DataFrame, models: DataFrame, names: list[str], key: str = "fold", known: Known = finite) -> DataFrame:
    """Rows with p_up, p_flat, p_down and the likeliest class; all null where a feature is missing or there is no model."""
    held = rows.join(models, key, "left").withColumn("_z", standardised(vector(names, known)))
    logits = [F.get("intercepts", F.lit(k)) + dot(F.col("_z"), F.get("coefficients", F.lit(k))) for k in range(len(CLASSES))]
    held = held.withColumns({f"_l{k}": v for k, v in enumerate(logits)})
    p = softmax(*[F.col(f"_l{k}") for k in range(len(CLASSES))])
    held = held.withColumns({f"p_{c.lower()}": F.when(F.col("_l0").isNotNull(), p[k]) for k, c in enumerate(CLASSES)})
    said = F.when(F.col("p_up").isNotNull(), likeliest(F.col("p_up"), F.col("p_flat"), F.col("p_down")))
    return held.withColumn("predicted", said).drop("means", "scales", "coefficients", "intercepts", "row_count", "_z", "_l0", "_l1", "_l2")


VERSION = 1


def to_documents(models: DataFrame, kind: str) -> DataFrame:
    """Fitted models as one JSON text each, with keys in order, a kind and a version."""
    columns = sorted(models.columns)
    return models.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*columns).alias("model"), F.lit(VERSION).alias("version"))).alias("document"))


def from_documents(documents: DataFrame, kind: str, schema: str) -> DataFrame:
    """Models from JSON texts; texts of another kind or version, or that don't parse, are left out."""
    parsed = documents.select(F.from_json("document", f"kind string, model struct<{schema}>, version int").alias("d"))
    return parsed.where((F.col("d.kind") == kind) & (F.col("d.version") == VERSION) & F.col("d.model").isNotNull()).select("d.model.*")
