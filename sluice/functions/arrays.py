"""Element-wise functions on arrays of equal length, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _checked(a: Column, b: Column, out: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("arrays of different lengths")))


def _zip(a, b, fn) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return _checked(a, b, F.zip_with(a, b, fn))


def array_add(a, b) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def array_multiply(a, b) -> Column:
    return _zip(a, b, lambda x, y: x * y)


def array_divide(a, b) -> Column:
    return _zip(a, b, lambda x, y: x / y)


def array_min2(a, b) -> Column:
    return _zip(a, b, lambda x, y: F.least(x, y))


def array_max2(a, b) -> Column:
    return _zip(a, b, lambda x, y: F.greatest(x, y))


def array_fold(a, start: Column, step) -> Column:
    """Left fold of one array."""
    return F.aggregate(F.col(a) if isinstance(a, str) else a, start, step)


def rounded(a, factor: int) -> Column:
    """Elements times a whole number, rounded half away from zero. The product has the elements' type: Spark's own rules would
    take floats to doubles, which fall on the other side of a half where the float's product is rounded onto it."""
    return F.transform(F.col(a) if isinstance(a, str) else a, lambda x: F.round(x * F.lit(factor).cast("float")))


def dot(a, b) -> Column:
    return F.aggregate(array_multiply(a, b), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a, b) -> Column:
    return F.aggregate(_zip(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
