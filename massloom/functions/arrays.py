"""Array expressions: dot products, correlation, medians, ordered picks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))))


def normalised_dot(a: Column, b: Column, root: bool = False) -> Column:
    """Cosine of two arrays, of their square roots where ``root``; 0 where one is all zeros."""
    if root:
        a, b = F.transform(a, F.sqrt), F.transform(b, F.sqrt)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of equal length; null if either is constant."""
    n = F.size(a)
    ma, mb = total(a) / n, total(b) / n
    da, db = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    norm = F.sqrt(dot(da, da) * dot(db, db))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("arrays of unequal length"))).when(norm > 0, dot(da, db) / norm)


def median(values: Column) -> Column:
    """Mean of the middle two; null for an empty array."""
    s = F.array_sort(values)
    n = F.size(values)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2)


def top_k(values: Column, k: int) -> Column:
    """The k largest, largest first."""
    return F.slice(F.reverse(F.array_sort(values)), 1, k)


def log_sum_exp(values: Column) -> Column:
    m = F.array_max(values)
    return m + F.ln(total(F.transform(values, lambda x: F.exp(x - m))))


def linspace(start: float, stop: float, n: int) -> Column:
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(start) + k * F.lit(step))
