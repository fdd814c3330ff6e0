"""Numeric column expressions whose results follow IEEE 754, as array libraries give them.

Spark's ANSI mode raises on division by zero and its logarithm is NULL for arguments up to zero; the
helpers here return infinities and NaN instead. NULL in gives NULL out.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

_INF, _NAN = float("inf"), float("nan")


def ieee_ln(x: Column) -> Column:
    """ln: -inf at zero, NaN below (and for NaN)."""
    return F.when(F.isnan(x), F.lit(_NAN)).when(x > 0, F.log(x)).when(x == 0, F.lit(-_INF)).when(x < 0, F.lit(_NAN))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b: infinite with the sign of a where b is zero, NaN for 0 / 0."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(_NAN)).when(a > 0, F.lit(_INF)).when(a < 0, F.lit(-_INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def log_return(a: Column, b: Column) -> Column:
    """ln(a / b)."""
    return ieee_ln(ieee_div(a, b))


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def total(columns: list[Column]) -> Column:
    """Row-wise sum; NULL if any part is."""
    return reduce(add, columns)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_with_logits(logit: Column, target: Column) -> Column:
    """Binary cross-entropy of a logit, stable for large magnitudes."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def softmax_over(x: Column, group: WindowSpec) -> Column:
    """Softmax among a group's non-null values; NULL values get none."""
    e = F.exp(x - F.max(x).over(group))
    return e / F.sum(e).over(group)


def nan_to_null(x: Column) -> Column:
    """Spark orders NaN above every number, so NaN input becomes NULL before any comparison."""
    return F.when(~F.isnan(x), x)


def is_up(y: Column) -> Column:
    """Binary direction target: 1 above zero; 0 otherwise, NaN and NULL included."""
    return F.when(nan_to_null(y) > 0, 1.0).otherwise(0.0)


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)
