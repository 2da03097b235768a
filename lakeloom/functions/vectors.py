"""Vector functions as native expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def inner_product(a: str | Column, b: str | Column) -> Column:
    """Sum of products; null if either vector is null or their lengths differ."""
    pairs = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: str | Column) -> Column:
    return F.sqrt(inner_product(v, v))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, inner_product(a, b) / n)


def l2_normalize(v: str | Column) -> Column:
    """v / |v|; a zero vector stays."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def shifted_cosine(a: str | Column, b: str | Column) -> Column:
    """2 c - 1 to four digits, which undoes a store's scaling of cosines to [0, 1]."""
    return F.round(2 * cosine(a, b) - 1, 4)


def or_zero(v: str | Column, dim: int) -> Column:
    """The vector, or dim zeros where it is missing."""
    return F.coalesce(as_double(v), F.array_repeat(F.lit(0.0), dim))
