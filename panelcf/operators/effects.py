"""Effects, fit quality and weight tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcf.functions.columns import STATION_TEXT, as_date, present
from panelcf.functions.periods import is_post, is_post_ex, is_pre
from panelcf.sources.upsert import first_per_key


def capitalised(name: str) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, F.lit(2), F.length(name))))


def att_series(fit: DataFrame) -> DataFrame:
    """Observed minus synthetic per unit, method and date."""
    return fit.withColumn("att", F.col("y") - F.col("y_hat"))


def with_periods(fit: DataFrame, assignments: DataFrame) -> DataFrame:
    """Attach each unit's start and excluded window."""
    dates = assignments.select("treated_id", "start", "ex_low", "ex_high")
    return fit.drop("start", "ex_low", "ex_high").join(dates, "treated_id")


def att_summary(fit: DataFrame, start="start", window=("ex_low", "ex_high"),
                keys: tuple[str, ...] = ("treated_id", "method")) -> DataFrame:
    """Mean effect before, after, and after without the window; missing days are skipped.

    ``start`` and ``window`` are dates, or columns when every unit has its own.
    """
    att, date = F.col("y") - F.col("y_hat"), F.col("date")
    return fit.groupBy(*keys).agg(
        F.avg(F.when(is_pre(date, start), att)).alias("att_pre"),
        F.avg(F.when(is_post(date, start), att)).alias("att_post"),
        F.avg(F.when(is_post_ex(date, start, window), att)).alias("att_post_ex"),
    ).withColumn("method", capitalised("method"))


def rmse(fit: DataFrame, start="start", keys: tuple[str, ...] = ("treated_id", "method")) -> DataFrame:
    """Root mean squared error before and after the start."""
    error, date = F.pow(F.col("y") - F.col("y_hat"), 2), F.col("date")
    return fit.groupBy(*keys).agg(
        F.sqrt(F.avg(F.when(is_pre(date, start), error))).alias("rmse_pre"),
        F.sqrt(F.avg(F.when(is_post(date, start), error))).alias("rmse_post"),
    )


def r2(fit: DataFrame, start="start", keys: tuple[str, ...] = ("treated_id", "method")) -> DataFrame:
    """Share of the pre-start variance explained: 1 - SSE / SST; null for a constant series."""
    pre = fit.filter(is_pre(F.col("date"), as_date(start)) & F.col("y").isNotNull() & F.col("y_hat").isNotNull())
    sse = F.sum(F.pow(F.col("y") - F.col("y_hat"), 2))
    return pre.groupBy(*keys).agg((1 - F.try_divide(sse, F.var_pop("y") * F.count("y"))).alias("r2_pre"))


def weights_table(weights: DataFrame, m: DataFrame, one_name: bool = False, ordered: bool = False) -> DataFrame:
    """Weights with the donors' descriptions, largest weight first.

    A donor with several distinct descriptions appears once for each, unless
    ``one_name`` keeps only the smallest one.
    """
    text = present(m, STATION_TEXT)
    meta = m.select("station_id", *text)
    meta = first_per_key(meta, ["station_id"], []) if one_name else meta.distinct()
    table = weights.select("treated_id", "method", "station_id", "weight").join(meta, "station_id", "left")
    out = table.select("treated_id", "method", "station_id", *text, "weight")
    return out.orderBy("treated_id", "method", F.desc("weight"), "station_id") if ordered else out


def weight_ranking(weights: DataFrame, methods: list[str]) -> DataFrame:
    """Per donor the weight of every method (0 if absent) and their mean size."""
    each = {
        m: F.coalesce(F.sum(F.when(F.col("method") == m, F.col("weight"))), F.lit(0.0)) for m in methods
    }
    wide = weights.groupBy("treated_id", "station_id").agg(*[w.alias(m) for m, w in each.items()])
    size = sum((F.abs(F.col(m)) for m in methods), F.lit(0.0)) / len(methods)
    return wide.withColumn("mean_abs", size)
