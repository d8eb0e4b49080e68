"""Full gradients, losses and weight recovery as one-pass aggregations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginspark.functions import batches as B
from marginspark.functions import margin as M
from marginspark.functions.vectors import UNROLL_LIMIT
from marginspark.operators import sums
from marginspark.params import MarginParams


def _long(partials: DataFrame, name: str) -> DataFrame:
    """Sum vectors ``v`` component-wise; partial sums are combined before the
    shuffle, which moves one value per component and task."""
    return (
        partials.select(F.posexplode("v").alias("j", "v"))
        .groupBy("j")
        .agg(F.sum("v").alias(name))
    )


def weighted_sum(df: DataFrame, weight: Column, n: int, name: str = "w") -> DataFrame:
    """``sum(weight * x)`` as rows ``(j, name)``.

    Short vectors are one JVM aggregate with a sum per component; wide ones
    are summed per task with numpy first.
    """
    rows = df.select("x", weight.cast("double").alias("_weight"))
    if n <= UNROLL_LIMIT:
        totals = [F.sum(F.col("_weight") * F.col("x")[j]) for j in range(n)]
        vector = F.array(*[F.coalesce(s, F.lit(0.0)) for s in totals])
        return rows.agg(vector.alias("v")).select(F.posexplode("v").alias("j", name))

    def add(batch):
        return B.numbers(batch["_weight"]) @ B.matrix(batch["x"])

    partials = rows.mapInArrow(lambda it: B.partial_sum(it, add), "v array<double>")
    return _long(partials, name)


def weighted_sums_by(df: DataFrame, key: str, weight: Column, n: int, image=None) -> DataFrame:
    """:func:`weighted_sum` per ``key``, as rows ``(key, w array)``; wide vectors
    are summed whole, see :mod:`sums`, and so are the vectors' images."""
    rows = df.select(key, "x", weight.cast("double").alias("_weight"))
    if n <= UNROLL_LIMIT and image is None:
        totals = [F.sum(F.col("_weight") * F.col("x")[j]) for j in range(n)]
        return rows.groupBy(key).agg(F.array(*totals).alias("w"))

    def add(batch):
        X, weights = B.matrix(batch["x"]), B.numbers(batch["_weight"])
        X = image(X) if image else X
        return lambda at: weights[at] @ X[at]

    return sums.vectors_by(rows, key, add).withColumnRenamed("v", "w")


def loss_gradient(
    points: DataFrame, w: Sequence[float], p: MarginParams, m: float
) -> DataFrame:
    """Gradient of the batch loss at ``w``, without the norm term: ``(j, g)``."""
    w = np.asarray(w, dtype=float)
    if len(w) <= UNROLL_LIMIT:
        slope = M.loss_slope(M.score("x", "y", w), p, m) * F.col("y")
        return weighted_sum(points, slope, len(w), "g")

    def add(batch):
        X, y = B.matrix(batch["x"]), B.numbers(batch["y"])
        return (B.slope(y * (X @ w), p, m) * y) @ X

    partials = points.select("x", "y").mapInArrow(
        lambda it: B.partial_sum(it, add), "v array<double>"
    )
    return _long(partials, "g")


def full_gradient(
    points: DataFrame, w: Sequence[float], p: MarginParams, m: float
) -> DataFrame:
    """Gradient of the whole objective at ``w``: rows ``(j, g)``.  ``m`` divides
    the loss; a sampled batch may be passed with the row count of all data."""
    base = F.element_at(F.array(*[F.lit(float(v)) for v in w]), F.col("j") + 1)
    return loss_gradient(points, w, p, m).select("j", (F.col("g") + base).alias("g"))


def gradient_vector(
    points: DataFrame, w: Sequence[float], p: MarginParams, m: float
) -> np.ndarray:
    """:func:`full_gradient` on the driver (``n`` numbers)."""
    g = np.array(w, dtype=float)
    for row in loss_gradient(points, w, p, m).collect():
        g[row["j"]] += row["g"]
    return g


def batch_loss(
    points: DataFrame, w: Sequence[float], p: MarginParams, m: float
) -> DataFrame:
    """Sum of row losses, without the norm term: one row ``batch_loss``."""
    loss = M.row_loss(M.score("x", "y", w), p, m)
    return points.agg(F.coalesce(F.sum(loss), F.lit(0.0)).alias("batch_loss"))


def objective(
    points: DataFrame, w: Sequence[float], p: MarginParams, m: float
) -> DataFrame:
    """Half the squared length of ``w`` plus the batch loss."""
    half = 0.5 * float(np.dot(w, w))
    return batch_loss(points, w, p, m).select(
        (F.col("batch_loss") + F.lit(half)).alias("objective")
    )


def band_summary(
    points: DataFrame, w: Sequence[float], p: MarginParams, m: float
) -> DataFrame:
    """Rows and loss per margin band."""
    scored = points.select(M.score("x", "y", w).alias("s"))
    return scored.groupBy(M.band(F.col("s"), p).alias("band")).agg(
        F.count("*").alias("n"),
        F.sum(M.row_loss(F.col("s"), p, m)).alias("loss"),
    )


def recover_weights(duals: DataFrame, n: int) -> DataFrame:
    """Primal weights of a dual state: ``sum(y * (zeta - beta) * x)`` as
    ``(j, w)``."""
    return weighted_sum(duals, M.signed_coef("y", "zeta", "beta"), n, "w")


def to_vector(long: DataFrame, n: int, name: str = "w") -> np.ndarray:
    out = np.zeros(n)
    for row in long.collect():
        out[row["j"]] = row[name]
    return out
