"""Counts, shares and safe division."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def share(condition: Column) -> Column:
    """Share of the rows, among those where the condition is not null, that meet it."""
    return F.avg(condition.cast("int"))


def rate(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, null when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def is_finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
