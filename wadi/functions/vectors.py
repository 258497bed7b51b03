"""Vector arithmetic on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also inside lambdas, where a column is worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def unit(a: Column) -> Column:
    return _let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0))))


def blend(a: Column, b: Column, share: float = 0.7) -> Column:
    """``share`` * a + (1 - share) * b, of unit length."""
    return _let(F.zip_with(a, b, lambda x, y: x.cast("double") * share + y.cast("double") * (1 - share)), unit)


def softmax(a: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    parts = lambda e: _let(total(e), lambda t: F.transform(e, lambda x: x / t))
    return _let(F.array_max(a), lambda top: _let(F.transform(a, lambda x: F.exp(x - top)), parts))


def log_sum_exp(a: Column) -> Column:
    return _let(F.array_max(a), lambda top: top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def argmax(a: Column) -> Column:
    """0-based, first of equals."""
    return F.array_position(a, F.array_max(a)) - 1


def rms(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.greatest(F.size(a), F.lit(1)))
