"""Column expressions over ``array<double>`` vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this many terms a dot product with literals is written out, which keeps
# it inside whole-stage codegen; wider vectors use the array functions.
UNROLL_LIMIT = 32


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column | str, b: Column | str) -> Column:
    """Linear kernel of two vector columns."""
    products = F.zip_with(_col(a), _col(b), lambda p, q: p * q)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def dot_literal(a: Column | str, weights: Sequence[float]) -> Column:
    """Dot product of a vector column with known weights."""
    a = _col(a)
    if len(weights) > UNROLL_LIMIT:
        return dot(a, literal(weights))
    total = F.lit(0.0)
    for j, w in enumerate(weights):
        total = total + a[j] * F.lit(float(w))
    return total


linear_kernel = dot


def squared_distance(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(_col(a), _col(b), lambda p, q: (p - q) * (p - q))
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)


def rbf_kernel(a: Column | str, b: Column | str, sigma: float = 1.0) -> Column:
    return F.exp(-squared_distance(a, b) / F.lit(2.0 * sigma * sigma))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column | str, factor: Column) -> Column:
    return F.transform(_col(a), lambda v: v * factor)


def axpy(factor: Column, a: Column | str, b: Column | str) -> Column:
    """``factor * a + b``."""
    return F.zip_with(_col(a), _col(b), lambda p, q: factor * p + q)


def join_text(a: Column | str, sep: str = ",") -> Column:
    return F.concat_ws(sep, _col(a).cast("array<string>"))
