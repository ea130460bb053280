"""Filling missing values along a series.

The neighbours of a gap are carried by two running "last value seen" windows,
one per direction, over the rows that exist; the missing steps are generated
afterwards. Running frames cost one pass, unlike a "rest of the series" frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcf.functions.columns import HOUSE, STATION_TEXT, PanelCols, present
from panelcf.operators.quality import unique_days


def _linear(left: Column, right: Column, at: Column, y: str) -> Column:
    """Line through two known points, flat where only one of them exists."""
    span = F.datediff(right["t"], left["t"]) if y == "date" else right["t"] - left["t"]
    done = F.datediff(at, left["t"]) if y == "date" else at - left["t"]
    between = F.when(
        left["t"].isNotNull() & right["t"].isNotNull() & (span > 0),
        left["v"] + (right["v"] - left["v"]) * done / span,
    )
    return F.coalesce(between, left["v"], right["v"])


def _known(t: str, v: str) -> Column:
    return F.when(F.col(v).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).alias("v")))


def interpolate_time(m: DataFrame, max_missing_ratio: float = 0.2, cols: PanelCols = HOUSE,
                     on_duplicates: str = "mean") -> tuple[DataFrame, DataFrame]:
    """Daily grid per station with time-linear filling, flat at both ends.

    Returns ``(filled panel, dropped ids)``: stations whose missing share exceeds
    the limit are dropped. Names and zone of the first row are repeated on added
    days; all other columns (such as coordinates) stay null there.
    """
    graded = _graded_days(m, cols, on_duplicates)
    kept = graded.filter(F.col("_missing") / F.col("_days") <= F.lit(max_missing_ratio))
    dropped = (
        graded.filter(F.col("_missing") / F.col("_days") > F.lit(max_missing_ratio))
        .select(cols.id).distinct()
    )
    forward = Window.partitionBy(cols.id).orderBy(F.asc(cols.date))
    backward = Window.partitionBy(cols.id).orderBy(F.desc(cols.date))
    sofar = (Window.unboundedPreceding, Window.currentRow)
    here = _known(cols.date, cols.value)
    sided = kept.withColumn("_after", F.last(here, True).over(backward.rowsBetween(*sofar)))
    sided = sided.withColumns({
        "_before": F.last(here, True).over(forward.rowsBetween(*sofar)),
        "_next": F.lead("_after").over(forward),
        "_until": F.coalesce(F.date_sub(F.lead(cols.date).over(forward), 1), F.col(cols.date)),
    })
    grid = sided.withColumn("_day", F.explode(F.sequence(cols.date, "_until")))
    seen = F.col("_day") == F.col(cols.date)
    right = F.when(seen, F.col("_after")).otherwise(F.col("_next"))
    filled = F.when(seen & F.col(cols.value).isNotNull(), F.col(cols.value)).otherwise(
        _linear(F.col("_before"), right, F.col("_day"), "date")
    )
    repeated = present(m, (*STATION_TEXT, "zone"))
    blank = [c for c in m.columns if c not in (*cols.names, *repeated)]
    out = grid.withColumns({
        "_filled": filled, **{c: F.when(seen, F.col(f"`{c}`")) for c in blank},
    })
    return out.select(*[
        F.col("_day").alias(c) if c == cols.date
        else F.col("_filled").alias(c) if c == cols.value
        else F.col(f"_name.`{c}`").alias(c) if c in repeated
        else F.col(f"`{c}`") for c in m.columns
    ]), dropped


def _graded_days(m: DataFrame, cols: PanelCols, on_duplicates: str) -> DataFrame:
    """One row per day with the station's day count, missing count and first names."""
    whole = Window.partitionBy(cols.id)
    repeated = present(m, (*STATION_TEXT, "zone"))
    span = F.datediff(F.max(cols.date).over(whole), F.min(cols.date).over(whole)) + 1
    named = {"_name": F.min(F.struct(cols.date, *repeated)).over(whole)} if repeated else {}
    return unique_days(m, cols, on_duplicates).withColumns({
        "_days": span, "_missing": span - F.count(cols.value).over(whole), **named,
    })


def panel_spine(m: DataFrame, cols: PanelCols = HOUSE, group: str | None = None) -> DataFrame:
    """Every station (of a group) on every date of the panel (of that group).

    The date list is no longer than the calendar. Without a group it is a scalar
    subquery; with one it is a single row per group that joins the stations.
    """
    if group is None:
        dates = m.select(F.collect_set(cols.date)).scalar()
        return m.select(cols.id).distinct().select(cols.id, F.explode(dates).alias(cols.date))
    dates = m.groupBy(group).agg(F.collect_set(cols.date).alias("_dates"))
    series = m.select(group, cols.id).distinct()
    return series.join(dates, group).select(group, cols.id, F.explode("_dates").alias(cols.date))


def interpolate_position(m: DataFrame, cols: PanelCols = HOUSE, group: str | None = None) -> DataFrame:
    """Linear filling by row position on the panel's own dates, flat at both ends."""
    keys = [*([group] if group else []), cols.id]
    days = unique_days(m.select(*keys, cols.date, cols.value), cols, keys=tuple(keys[:-1]))
    rows = panel_spine(days, cols, group).join(days, [*keys, cols.date], "left")
    forward = Window.partitionBy(*keys).orderBy(F.asc(cols.date))
    backward = Window.partitionBy(*keys).orderBy(F.desc(cols.date))
    sofar = (Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_p", F.row_number().over(forward))
    here = _known("_p", cols.value)
    sided = placed.withColumns({
        "_before": F.last(here, True).over(forward.rowsBetween(*sofar)),
        "_after": F.last(here, True).over(backward.rowsBetween(*sofar)),
    })
    value = F.coalesce(F.col(cols.value), _linear(F.col("_before"), F.col("_after"), F.col("_p"), "row"))
    return sided.select(*keys, cols.date, value.alias(cols.value))
