"""Small numeric helpers shared by all other modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(value) -> Column:
    """Column from a name, a number or a Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def clamp(value, low, high) -> Column:
    return F.greatest(c(low), F.least(c(high), c(value)))


def clamp01(value) -> Column:
    """max(0, min(1, x)). Like SQL LEAST, a null argument is skipped, so nullable input goes through `unit`."""
    return clamp(value, F.lit(0.0), F.lit(1.0))


def unit(value, default: float = 0.0) -> Column:
    """Null-safe clamp01, the form in which score columns are always read."""
    return clamp01(F.coalesce(c(value), F.lit(float(default))))


def finite01(value) -> Column:
    """clamp01 that also maps NaN, +Inf and -Inf to 0."""
    x = c(value)
    inf = F.lit(float("inf"))
    return F.when(x.isNull() | F.isnan(x) | (x == inf) | (x == -inf), 0.0).otherwise(clamp01(x))


def round_half_up(value, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, so that negative halves round towards +Inf."""
    scale = float(10**digits)
    return F.floor(c(value) * scale + 0.5) / scale


def graded(value, floor: float, full: float) -> Column:
    """Linear membership: 0 at `floor`, 1 at `full`."""
    return clamp01((c(value) - floor) / max(0.01, full - floor))


def weighted_sum(pairs) -> Column:
    """Sum of column * weight over (column, weight) pairs."""
    total = None
    for value, weight in pairs:
        term = c(value) * weight
        total = term if total is None else total + term
    return total


def mean_of(*values) -> Column:
    total = c(values[0])
    for value in values[1:]:
        total = total + c(value)
    return total / float(len(values))


def int_div(value, divisor: int) -> Column:
    """Integer division truncating towards zero, for non-negative input."""
    return F.floor(c(value) / divisor).cast("int")
