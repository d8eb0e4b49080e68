"""Margins, bands, losses and gradients as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginspark.functions import vectors as V
from marginspark.params import MarginParams


def score(x: Column | str, y: Column | str, w: Sequence[float]) -> Column:
    """The margin ``y * (w . x)``."""
    y = F.col(y) if isinstance(y, str) else y
    return y * V.dot_literal(x, w)


def band(s: Column, p: MarginParams) -> Column:
    """Which side of the free band a margin lies on; both bounds are strict."""
    return F.when(s < p.low, "low").when(s > p.high, "high").otherwise("mid")


def _by_band(s: Column, p: MarginParams, low: Column, high: Column) -> Column:
    return F.when(s < p.low, low).when(s > p.high, high).otherwise(F.lit(0.0))


def row_loss(s: Column, p: MarginParams, m: float) -> Column:
    """One row's share of the batch loss, without the norm term."""
    c = p.loss_weight(m)
    below, above = F.lit(p.low) - s, s - F.lit(p.high)
    return _by_band(s, p, below * below * c, above * above * (c * p.mu))


def loss_slope(s: Column, p: MarginParams, m: float = 1.0) -> Column:
    """Derivative of the row loss by the margin; times ``y * x`` it is the
    row's gradient.  ``m=1`` gives the single-sample form."""
    c = 2.0 * p.loss_weight(m)
    return _by_band(s, p, (s - F.lit(p.low)) * c, (s - F.lit(p.high)) * (c * p.mu))


def sample_loss(s: Column, w: Sequence[float], p: MarginParams) -> Column:
    """Loss of one sample: off the band the squared deviation plus half the
    length of ``w``, inside the band zero; not divided by the row count."""
    half_norm = F.lit(0.5 * sum(float(v) ** 2 for v in w) ** 0.5)
    loss = row_loss(s, p, 1.0)
    return _by_band(s, p, loss + half_norm, loss + half_norm)


def sample_gradient(
    x: Column | str, y: Column | str, w: Sequence[float], p: MarginParams
) -> Column:
    """``w`` plus the sample's slope along ``y * x``; inside the band just ``w``."""
    y = F.col(y) if isinstance(y, str) else y
    slope = loss_slope(score(x, y, w), p) * y
    return V.axpy(slope, x, V.literal(w))


def label_scaled(x: Column | str, y: Column | str) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return V.scale(x, y.cast("double"))


def signed_coef(y: Column | str, zeta: Column | str, beta: Column | str) -> Column:
    y, zeta, beta = (F.col(c) if isinstance(c, str) else c for c in (y, zeta, beta))
    return y * (zeta - beta)


def is_support(zeta: Column | str, beta: Column | str) -> Column:
    zeta, beta = (F.col(c) if isinstance(c, str) else c for c in (zeta, beta))
    return zeta + beta > 0
