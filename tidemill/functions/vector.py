"""Vector arithmetic on array columns, accumulated as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def safe_cosine(a: Column, b: Column) -> Column:
    """0 where either norm is TINY at most."""
    return F.when((norm(a) <= TINY) | (norm(b) <= TINY), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norm(a) * norm(b)))


def normalise(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(TINY))
    return F.transform(doubles(a), lambda x: (x / n).cast("float"))


def valid(v: Column, size: int) -> Column:
    """A vector as array<float>, null unless it has `size` finite members."""
    f = v.cast("array<float>")
    good = (F.size(f) == size) & F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, f)
