"""Panel quality: calendars, missing days, gaps.

Every operator that looks along a series first reduces it to one row per
station and day. That happens with partial sums before the shuffle, so a
station that owns a large share of the raw rows still ends up with at most one
row per calendar day, and no window or group can grow beyond the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcf.functions.calendar import days_spanned, month_index
from panelcf.functions.columns import HOUSE, STATION_TEXT, PanelCols, present


def unique_days(m: DataFrame, cols: PanelCols = HOUSE, on_duplicates: str = "mean",
                keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per station and date, other columns kept (smallest if they differ).

    ``on_duplicates``: "mean" averages repeated days, "error" refuses them.
    """
    if on_duplicates not in ("mean", "error"):
        raise ValueError("on_duplicates must be 'mean' or 'error'")
    group = [*keys, cols.id, cols.date]
    value = F.avg(cols.value)
    if on_duplicates == "error":
        clash = F.raise_error(F.lit("a station has several rows on one date")).cast("double")
        value = F.when(F.count(F.lit(1)) > 1, clash).otherwise(value)
    rest = [c for c in m.columns if c not in (*group, cols.value)]
    days = m.groupBy(*group).agg(
        value.alias(cols.value),
        *([F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_rest")] if rest else []),
    )
    return days.select(*[
        F.col(f"_rest.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in m.columns
    ])


def complete_calendar(m: DataFrame, freq: str = "day", cols: PanelCols = HOUSE) -> DataFrame:
    """Every day (or month start) between a station's first and last row.

    The missing steps are generated between a row and its successor, so the
    full grid needs neither a separate calendar table nor a join.
    """
    if freq not in ("day", "month"):
        raise ValueError("freq must be 'day' or 'month'")
    along = Window.partitionBy(cols.id).orderBy(cols.date)
    step = F.expr(f"interval 1 {freq}")
    following = F.lead(cols.date).over(along)
    last = F.coalesce((following - step).cast("date"), F.col(cols.date))
    rows = unique_days(m, cols).withColumn("_last", last)
    grid = rows.withColumn("_step", F.explode(F.sequence(cols.date, "_last", step)))
    seen = F.col("_step") == F.col(cols.date)
    carried = {c: F.when(seen, F.col(f"`{c}`")) for c in m.columns if c not in (cols.id, cols.date)}
    return grid.withColumns(carried).withColumn(cols.date, F.col("_step").cast("date")).select(*m.columns)


def missing_summary(m: DataFrame, cols: PanelCols = HOUSE, ordered: bool = False) -> DataFrame:
    """Missing days per station on its own calendar, with its first description.

    Counting the distinct observed days is enough; no calendar is generated.
    """
    text = present(m, STATION_TEXT)
    observed = F.when(F.col(cols.value).isNotNull(), F.col(cols.date))
    summary = m.groupBy(cols.id).agg(
        F.min(cols.date).alias("date_min"),
        F.max(cols.date).alias("date_max"),
        F.count_distinct(observed).alias("_seen"),
        *([F.min(F.struct(cols.date, *text)).alias("_first")] if text else []),
    )
    out = summary.select(
        cols.id,
        *[F.col(f"_first.{c}").alias(c) for c in text],
        (days_spanned(F.col("date_min"), F.col("date_max")) - F.col("_seen")).cast("long")
        .alias("missing_days"),
        days_spanned(F.col("date_min"), F.col("date_max")).cast("long").alias("n_days"),
        "date_min", "date_max",
    )
    return out.orderBy(F.desc("missing_days"), cols.id) if ordered else out


def missing_ratio(m: DataFrame, limit: float = 0.2, cols: PanelCols = HOUSE) -> tuple[DataFrame, DataFrame]:
    """``(kept rows, dropped ids with their ratio)``; only a ratio above ``limit`` drops."""
    ratios = missing_summary(m, cols).select(
        cols.id, (F.col("missing_days") / F.col("n_days")).alias("missing_ratio")
    )
    dropped = ratios.filter(F.col("missing_ratio") > F.lit(limit))
    return m.join(dropped.select(cols.id), cols.id, "left_anti"), dropped


def gap_intervals(m: DataFrame, cols: PanelCols = HOUSE) -> DataFrame:
    """Runs of consecutive missing days: start, end, length.

    Looks only at observed days plus one sentinel before the first and after the
    last row; a step of more than one day between neighbours is a gap.
    """
    text = [c for c in present(m, STATION_TEXT) if c == "station_name"]
    observed = F.when(F.col(cols.value).isNotNull(), F.col(cols.date))
    days = m.groupBy(cols.id, cols.date).agg(
        F.max(observed).alias("_seen"),
        *[F.min(c).alias(c) for c in text],
    )
    whole = Window.partitionBy(cols.id)
    along = whole.orderBy("_day")
    spans = days.withColumns({
        "_lo": F.min(cols.date).over(whole), "_hi": F.max(cols.date).over(whole),
        **{c: F.min(F.struct(cols.date, c)).over(whole)[c] for c in text},
    })
    marks = F.array_compact(F.array(
        F.col("_seen"),
        F.when(F.col(cols.date) == F.col("_lo"), F.date_sub("_lo", 1)),
        F.when(F.col(cols.date) == F.col("_hi"), F.date_add("_hi", 1)),
    ))
    steps = spans.select(cols.id, *text, F.explode(marks).alias("_day")).withColumn(
        "_next", F.lead("_day").over(along)
    )
    return steps.filter(F.datediff("_next", "_day") > 1).select(
        cols.id, *text,
        F.date_add("_day", 1).alias("gap_start"),
        F.date_sub("_next", 1).alias("gap_end"),
        (F.datediff("_next", "_day") - 1).cast("long").alias("gap_length_days"),
    )


def gap_edges(m: DataFrame, cols: PanelCols = HOUSE) -> DataFrame:
    """Each calendar day with its missing flag and the flags of both neighbours."""
    along = Window.partitionBy(cols.id).orderBy(cols.date)
    days = complete_calendar(m.select(*cols.names), "day", cols).withColumn(
        "is_missing", F.col(cols.value).isNull()
    )
    return days.withColumns({
        "missing_before": F.lag("is_missing", 1, False).over(along),
        "missing_after": F.lead("is_missing", 1, False).over(along),
    })


def missing_periods(m: DataFrame, cols: PanelCols = HOUSE) -> DataFrame:
    """Missing dates per station against all dates of the panel, without building the grid."""
    dates = m.select(F.count_distinct(cols.date)).scalar()
    observed = F.when(F.col(cols.value).isNotNull(), F.col(cols.date))
    return m.groupBy(cols.id).agg(
        (dates - F.count_distinct(observed)).alias("missing_periods")
    )


def keep_stations(m: DataFrame, max_missing: int = 12, cols: PanelCols = HOUSE) -> DataFrame:
    """Rows of the stations with at most ``max_missing`` missing dates."""
    good = missing_periods(m, cols).filter(F.col("missing_periods") <= max_missing)
    return m.join(good.select(cols.id), cols.id, "left_semi")


def trend_index(m: DataFrame, cols: PanelCols = HOUSE, contiguous_months: bool = False) -> DataFrame:
    """0, 1, 2, … along each series; month arithmetic suffices when no month is absent."""
    whole = Window.partitionBy(cols.id)
    if contiguous_months:
        at = month_index(F.col(cols.date))
        return m.withColumn("trend", (at - F.min(at).over(whole)).cast("long"))
    return m.withColumn("trend", (F.row_number().over(whole.orderBy(cols.date)) - 1).cast("long"))
