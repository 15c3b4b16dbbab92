"""Vector expressions on ARRAY<FLOAT> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalise(v: Column) -> Column:
    """Q1: unit length; a zero vector stays as it is."""

    def scaled(u: Column) -> Column:
        return bind(norm(u), lambda n: F.when(n > 0, F.transform(u, lambda x: x / n)).otherwise(u))

    return bind(v.cast("array<double>"), scaled)


def cosine(a: Column, b: Column) -> Column:
    """Q3: 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
