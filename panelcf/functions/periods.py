"""Before / after flags around a treatment date, with an optional window left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcf.functions.columns import as_date


def is_pre(date: Column, start) -> Column:
    return date < as_date(start)


def is_post(date: Column, start) -> Column:
    return date >= as_date(start)


def in_window(date: Column, window) -> Column:
    """True inside the window, both ends included; never null."""
    if window is None or window[0] is None or window[1] is None:
        return F.lit(False)
    return F.coalesce(date.between(as_date(window[0]), as_date(window[1])), F.lit(False))


def is_post_ex(date: Column, start, window) -> Column:
    return is_post(date, start) & ~in_window(date, window)


def period_names(date: Column, start, window=None) -> Column:
    """Array of the periods a date belongs to; explode it to stack the periods."""
    return F.array_compact(
        F.array(
            F.when(is_pre(date, start), F.lit("pre")),
            F.when(is_post(date, start), F.lit("post")),
            F.when(is_post_ex(date, start, window), F.lit("post_ex")),
        )
    )
