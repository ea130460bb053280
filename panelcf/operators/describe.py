"""Aggregates, contrasts, profiles, correlations and box statistics of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcf.functions.calendar import is_weekend, month_start
from panelcf.functions.columns import HOUSE, PanelCols, id_list
from panelcf.functions.periods import is_post, is_post_ex, is_pre
from panelcf.operators.pairs import correlation, pair_sums
from panelcf.operators.quality import complete_calendar, unique_days
from panelcf.operators.quantiles import exact_quantiles


def daily_mean(m: DataFrame, cols: PanelCols = HOUSE) -> DataFrame:
    return m.groupBy(cols.id, cols.date).agg(F.avg(cols.value).alias(cols.value))


def monthly_mean(m: DataFrame, min_days: int | None = None, with_empty: bool = False,
                 cols: PanelCols = HOUSE, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean per station and month start.

    ``min_days`` adds the number of values and blanks months with fewer;
    ``with_empty`` lists months without any row between a station's first and last.
    """
    month = month_start(F.col(cols.date)).alias(cols.date)
    value = F.avg(cols.value)
    extra = []
    if min_days is not None:
        value = F.when(F.count(cols.value) >= min_days, value)
        extra = [F.count(cols.value).alias("n_values")]
    monthly = m.groupBy(*keys, cols.id, month).agg(value.alias(cols.value), *extra)
    if not with_empty:
        return monthly
    grid = complete_calendar(monthly, "month", cols)
    return grid.fillna(0, ["n_values"]) if extra else grid


def to_wide(m: DataFrame, ids: list, cols: PanelCols = HOUSE) -> DataFrame:
    """Dates by stations, for a user-facing edge; the station list is given."""
    return m.groupBy(cols.date).pivot(cols.id, list(ids)).agg(F.avg(cols.value))


def to_long(wide: DataFrame, cols: PanelCols = HOUSE) -> DataFrame:
    """Inverse of ``to_wide``; cells without a value are left out."""
    ids = [c for c in wide.columns if c != cols.date]
    return wide.unpivot(cols.date, ids, cols.id, cols.value).filter(F.col(cols.value).isNotNull())


def rolling_mean(m: DataFrame, window: int = 30, cols: PanelCols = HOUSE) -> DataFrame:
    """Centred mean over ``window`` rows, shorter at the edges.

    An even window reaches one row further back than forward.
    """
    along = Window.partitionBy(cols.id).orderBy(cols.date)
    frame = along.rowsBetween(-(window // 2), (window - 1) // 2)
    return unique_days(m, cols).withColumn("smooth", F.avg(cols.value).over(frame))


def pre_post_summary(m: DataFrame, start, window=None, cols: PanelCols = HOUSE) -> DataFrame:
    """Mean, median, std (n-1), 10 % and 90 % points and count per station and period.

    Every station has the three periods (pre; post; post_ex), one without values with
    a count of 0. All in one scan; the groups hold one value per day, so exact
    percentiles stay small.
    """
    date = F.col(cols.date)
    periods = {"pre": is_pre(date, start), "post": is_post(date, start), "post_ex": is_post_ex(date, start, window)}
    each = []
    for name, inside in periods.items():
        v = F.when(inside, F.col(cols.value))
        each.append(F.struct(
            F.lit(name).alias("period"), F.avg(v).alias("mean"), F.median(v).alias("median"),
            F.stddev_samp(v).alias("std"), F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.9).alias("p90"),
            F.count(v).alias("n_days"),
        ).alias(name))
    wide = unique_days(m.select(*cols.names), cols).groupBy(cols.id).agg(*each)
    return wide.select(cols.id, F.explode(F.array(*periods)).alias("_p")).select(cols.id, "_p.*")


def month_profile(m: DataFrame, start, cols: PanelCols = HOUSE) -> DataFrame:
    """Mean by calendar month before and after, on the full spine 1…12."""
    date, v = F.col(cols.date), F.col(cols.value)
    months = m.groupBy(cols.id, F.month(date).alias("month")).agg(
        F.avg(F.when(is_pre(date, start), v)).alias("mean_pre"),
        F.avg(F.when(is_post(date, start), v)).alias("mean_post"),
    )
    entries = F.map_from_entries(F.collect_list(F.struct("month", F.struct("mean_pre", "mean_post"))))
    return months.groupBy(cols.id).agg(entries.alias("_m")).select(
        cols.id, "_m", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    ).select(
        cols.id, "month",
        F.try_element_at("_m", F.col("month"))["mean_pre"].alias("mean_pre"),
        F.try_element_at("_m", F.col("month"))["mean_post"].alias("mean_post"),
    )


def weekpart_profile(m: DataFrame, start, cols: PanelCols = HOUSE) -> DataFrame:
    """Mean on weekdays and weekends, before and after."""
    date, v = F.col(cols.date), F.col(cols.value)
    parts = {"weekday": ~is_weekend(date), "weekend": is_weekend(date)}
    periods = {"pre": is_pre(date, start), "post": is_post(date, start)}
    return m.groupBy(cols.id).agg(*[
        F.avg(F.when(p & w, v)).alias(f"{part}_{period}")
        for period, p in periods.items() for part, w in parts.items()
    ])


def donor_contrast(m: DataFrame, start, min_pre: int = 30, min_post: int = 30,
                   cols: PanelCols = HOUSE) -> DataFrame:
    """Mean and count before and after per station, their difference, stations with enough days.

    One conditional aggregate takes the place of two aggregates and an outer join.
    A station without any row in one of the periods is left out at every limit.
    """
    date, v = F.col(cols.date), F.col(cols.value)
    pre, post = F.when(is_pre(date, start), v), F.when(is_post(date, start), v)
    both = m.groupBy(cols.id).agg(
        F.avg(pre).alias("mean_pre"), F.count(pre).alias("n_pre"),
        F.avg(post).alias("mean_post"), F.count(post).alias("n_post"),
        (F.bool_or(is_pre(date, start)) & F.bool_or(is_post(date, start))).alias("_both"),
    )
    return both.filter(
        F.col("_both") & (F.col("n_pre") >= min_pre) & (F.col("n_post") >= min_post)
    ).withColumn("delta_post_pre", F.col("mean_post") - F.col("mean_pre")).drop("_both")


def _all_there(df: DataFrame, ids: list, cols: PanelCols) -> Column:
    """True, or an error if an id has no row; decided by an aggregate, which has a row even for an empty table."""
    found = F.count_distinct(F.when(F.col(cols.id).isin(ids), F.col(cols.id)))
    absent = F.raise_error(F.lit(f"not all of the stations {ids} are there")).cast("boolean")
    return df.agg(found.alias("n")).select(F.when(F.col("n") == len(set(ids)), F.lit(True)).otherwise(absent)).scalar()


def daily_levels(m: DataFrame, treated_id, start, cols: PanelCols = HOUSE) -> DataFrame:
    """Per day before the start: the treated value and the mean of all other stations.

    A station that the panel does not have is an error.
    """
    date, v = F.col(cols.date), F.col(cols.value)
    own = F.col(cols.id) == F.lit(treated_id)
    return m.filter(is_pre(date, start) & _all_there(m, [treated_id], cols)).groupBy(cols.date).agg(
        F.avg(F.when(own, v)).alias("treated"), F.avg(F.when(~own, v)).alias("donors_mean"),
    )


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 IQR) and outlier count per group."""
    fenced = _with_fences(df, group, value)
    v = F.col(value)
    inside = v.between(F.col("_low"), F.col("_high"))
    return fenced.groupBy(group, "q1", "median", "q3").agg(
        F.least(F.min(F.when(inside, v)), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, v)), F.col("q3")).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"), F.count(v).alias("n"),
    )


def box_outliers(df: DataFrame, group: str, value: str) -> DataFrame:
    """The points drawn beyond the whiskers."""
    v = F.col(value)
    return _with_fences(df, group, value).filter(~v.between(F.col("_low"), F.col("_high"))).select(group, value)


def _with_fences(df: DataFrame, group: str, value: str) -> DataFrame:
    points = df.select(group, value).filter(F.col(value).isNotNull())
    q = exact_quantiles(points, [group], value, [0.25, 0.5, 0.75]).select(
        group, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = q.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    return points.join(fences, group)


def delta_ranking(contrast: DataFrame, treated_id, cols: PanelCols = HOUSE) -> DataFrame:
    """Donor differences with the treated one beside each, ascending.

    ``treated_id`` must be in the contrast table.
    """
    absent = F.raise_error(F.lit(f"station {treated_id!r} is not in the contrast table")).cast("double")
    own = F.max(F.when(F.col(cols.id) == F.lit(treated_id), F.col("delta_post_pre")))
    delta = contrast.agg(own.alias("d")).select(F.when(F.col("d").isNull(), absent).otherwise(F.col("d"))).scalar()
    return (
        contrast.filter((F.col(cols.id) != F.lit(treated_id)) & F.col("delta_post_pre").isNotNull() & delta.isNotNull())
        .select(cols.id, "delta_post_pre", delta.alias("treated_delta"))
        .orderBy("delta_post_pre", cols.id)
    )


#: Up to so many treated stations, rows per pair and day are no more than a few times the panel.
FEW_TREATED = 4


def _joined_correlations(pre: DataFrame, ids: list, cols: PanelCols) -> DataFrame:
    treated = pre.filter(F.col(cols.id).isin(ids)).select(
        F.col(cols.id).alias("treated_id"), cols.date, F.col(cols.value).alias("_y")
    )
    pairs = pre.join(treated, cols.date).filter(
        F.col(cols.id) != F.col("treated_id")
    )
    x, y = F.col(cols.value), F.col("_y")
    both = x.isNotNull() & y.isNotNull()
    # Not F.corr: a constant series would divide by zero and stop the job.
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return (
        pairs.groupBy("treated_id", cols.id)
        .agg(F.try_divide(F.covar_pop(x, y), spread).alias("corr"), F.count_if(both).alias("n_days"))
        .filter(F.col("corr").isNotNull())
    )


def pre_correlations(m: DataFrame, treated_ids, start, cols: PanelCols = HOUSE,
                     on_duplicates: str = "error") -> DataFrame:
    """Correlation of every other station with each treated one before the start.

    Pairwise complete days; pairs without a defined correlation are left out. A treated
    station that the panel does not have is an error. For more than a few treated stations, sums are taken by blocks
    of stations and days (``operators.pairs``), so no row is made per pair and day.
    """
    ids = id_list(treated_ids)
    there = _all_there(m, ids, cols)
    pre = unique_days(m.select(*cols.names).filter(is_pre(F.col(cols.date), start) & there), cols, on_duplicates)
    if len(ids) <= FEW_TREATED:
        return _joined_correlations(pre, ids, cols)
    cells = pre.select(F.col(cols.id).alias("id"), F.col(cols.date).alias("date"), F.col(cols.value).cast("double").alias("value"))
    sums = pair_sums(cells, F.col("id").isin([str(i) for i in ids]))
    return sums.select(
        F.col("left_id").alias("treated_id"), F.col("right_id").alias(cols.id), correlation().alias("corr"), F.col("n").alias("n_days"),
    ).filter(F.col("corr").isNotNull())
