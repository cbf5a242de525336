"""Norms and distances of array columns, as higher-order functions inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda acc, v: acc + v)


def l1(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def linf(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, v: F.greatest(acc, v))


def minkowski(a: Column, b: Column, order: float) -> Column:
    """Sum of |x - y| ** order, without the root."""
    return _sum(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(order))))


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def histogram_intersection(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.least(x, y))


def chi_square(a: Column, b: Column) -> Column:
    """Sum of (x - y)2 / (x + y) where x + y > 0."""
    return _sum(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0))


def hellinger(a: Column, b: Column) -> Column:
    """Sum of (sqrt x - sqrt y)2 of non-negative entries."""
    return _sum(a, b, lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y)))


def kl(a: Column, b: Column) -> Column:
    """Sum of x log(x / y) where both are positive."""
    return _sum(a, b, lambda x, y: F.when((x > 0) & (y > 0), x * F.log(x / y)).otherwise(0.0))


def cs(a: Column, b: Column) -> Column:
    """Sum of (x - y)^2 / (x + y) where x + y is not 0."""
    return _sum(a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / (x + y)).otherwise(0.0))


def jm(a: Column, b: Column) -> Column:
    """Jeffries-Matusita norm: root of the Hellinger sum."""
    return F.sqrt(hellinger(a, b))


def bhattacharyya(a: Column, b: Column) -> Column:
    """-log of the sum of sqrt(x y), 0 where that sum is not positive."""
    s = _sum(a, b, lambda x, y: F.sqrt(F.abs(x * y)))
    return F.when(s > 0, -F.log(s)).otherwise(0.0)


def sublinear(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.sqrt(F.abs(x - y)))


def div(a: Column, b: Column) -> Column:
    """Sum of (x / y - 1) log(x / y) where x / y is positive."""
    return _sum(a, b, lambda x, y: F.when((y != 0) & (x / y > 0), (x / y - 1) * F.log(x / y)).otherwise(0.0))


def pf(a: Column, b: Column, p1: float, p2: float) -> Column:
    """Root of sum |p1 x - p2 y|."""
    return F.sqrt(_sum(a, b, lambda x, y: F.abs(x * p1 - y * p2)))


def k_norm(a: Column, b: Column, p1: float, p2: float) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x * p1 - y * p2))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two whole numbers."""
    return F.bit_count(a.bitwiseXOR(b))
