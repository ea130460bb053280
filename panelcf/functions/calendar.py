"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def days_spanned(first: Column, last: Column) -> Column:
    """Number of days from ``first`` to ``last``, both counted."""
    return F.datediff(last, first) + F.lit(1)


def is_weekend(date: Column) -> Column:
    """Saturday or Sunday (Monday is weekday 0)."""
    return F.weekday(date) >= 5


def cycle_sin(position: Column, length: int) -> Column:
    return F.sin(F.lit(2.0) * F.pi() * position / F.lit(length))


def cycle_cos(position: Column, length: int) -> Column:
    return F.cos(F.lit(2.0) * F.pi() * position / F.lit(length))


def month_index(date: Column) -> Column:
    """Months since year zero; differences count calendar months."""
    return F.year(date) * 12 + F.month(date)


def log_grid(low: float, high: float, size: int) -> Column:
    """``size`` values from 10^low to 10^high, evenly spaced in the exponent."""
    step = (high - low) / (size - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.pow(F.lit(10.0), F.lit(low) + i * F.lit(step)),
    )
