"""The complete-case panel behind a counterfactual: one treated series, many donors.

Assignments say which unit is treated, when, and against which donor set:
``treated_id, donor_set, start, ex_low, ex_high``. Donor sets are rows
``donor_set, station_id``. The working form keeps one row per treated unit and
date with the donor values in an array ordered by donor id, so that no step
multiplies rows by donors before it has to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcf.functions.columns import HOUSE, PanelCols, as_date, id_list
from panelcf.functions.calendar import cycle_cos, cycle_sin
from panelcf.operators.describe import daily_mean, monthly_mean


def assign(spark: SparkSession, treated_ids, start, window=None, donor_set: str = "all") -> DataFrame:
    """Assignments for a list of units that share start, window and donor set."""
    low, high = window or (None, None)
    rows = spark.createDataFrame([(t, donor_set) for t in id_list(treated_ids)], ["treated_id", "donor_set"])
    return rows.withColumns({
        "start": as_date(start),
        "ex_low": as_date(low) if low is not None else F.lit(None).cast("date"),
        "ex_high": as_date(high) if high is not None else F.lit(None).cast("date"),
    })


def assign_all(m: DataFrame, start, window=None, donor_set: str = "all", cols: PanelCols = HOUSE) -> DataFrame:
    """Every station of the panel takes the treated role once."""
    low, high = window or (None, None)
    return m.select(F.col(cols.id).alias("treated_id")).distinct().withColumns({
        "donor_set": F.lit(donor_set),
        "start": as_date(start),
        "ex_low": as_date(low) if low is not None else F.lit(None).cast("date"),
        "ex_high": as_date(high) if high is not None else F.lit(None).cast("date"),
    })


_DATES = ("start", "ex_low", "ex_high")


def _series(m: DataFrame, grain: str, cols: PanelCols) -> DataFrame:
    if grain not in ("month", "day"):
        raise ValueError("grain must be 'month' or 'day'")
    means = monthly_mean(m, cols=cols) if grain == "month" else daily_mean(m, cols)
    return means.select(
        F.col(cols.id).alias("station_id"), F.col(cols.date).alias("date"), F.col(cols.value).alias("x")
    )


def _with_roles(series: DataFrame, assignments: DataFrame, donor_sets: DataFrame | None):
    """Series rows with their roles, the gathering keys, and whether a row is a donor's.

    Without donor sets every station is a donor, the treated ones included.
    """
    if donor_sets is None:
        rows = series.join(assignments.drop("donor_set"), F.col("station_id") == F.col("treated_id"), "left")
        return rows, ["date"], F.lit(True)
    roles = donor_sets.select("donor_set", "station_id").unionByName(
        assignments.withColumn("station_id", F.col("treated_id")), allowMissingColumns=True)
    return series.join(roles, "station_id"), ["donor_set", "date"], F.col("treated_id").isNull()


def _gather(rows: DataFrame, keys: list[str], is_donor) -> DataFrame:
    """Per treated unit and date: its own value and the known donor values by id."""
    known = F.col("x").isNotNull()
    cell = F.when(known & is_donor, F.struct(F.col("station_id").alias("id"), "x"))
    role = F.when(known & F.col("treated_id").isNotNull(), F.struct("treated_id", F.col("x").alias("y"), *_DATES))
    by_date = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(cell)).alias("donors"), F.collect_list(role).alias("treated")
    )
    return by_date.select(*keys, "donors", F.explode("treated").alias("t")).select(
        *keys, "t.*", F.filter("donors", lambda d: d["id"] != F.col("t.treated_id")).alias("donors")
    )


def counterfactual_panel(m: DataFrame, assignments: DataFrame, donor_sets: DataFrame | None = None,
                         grain: str = "month", cols: PanelCols = HOUSE) -> DataFrame:
    """``treated_id, date, y, donors, start, ex_low, ex_high, is_pre``, complete dates only.

    ``donors`` is an array of ``(id, x)`` ordered by id, never holding the treated
    unit. A date stays only if the treated unit and every donor that occurs in the
    data have a value on it. Without ``donor_sets`` every other station is a donor.
    A unit has one assignment. Treated and donor roles are gathered per date from
    a single pass over the series; only the station count reads it once more.
    """
    series = _series(m, grain, cols)
    rows, keys, is_donor = _with_roles(series, assignments, donor_sets)
    gathered = _gather(rows, keys, is_donor)
    if donor_sets is None:
        n_donors = series.select(F.count_distinct("station_id")).scalar() - 1
    else:
        members = rows.filter(is_donor).groupBy("donor_set").agg(F.collect_set("station_id").alias("members"))
        gathered = gathered.join(members, "donor_set")
        n_donors = F.size("members") - F.array_contains("members", F.col("treated_id")).cast("int")
    return gathered.filter((F.size("donors") == n_donors) & (n_donors > 0)).select(
        "treated_id", "date", "y", "donors", *_DATES, (F.col("date") < F.col("start")).alias("is_pre"),
    )


def monthly_panel(m: DataFrame, assignments: DataFrame, donor_sets: DataFrame | None = None,
                  cols: PanelCols = HOUSE) -> DataFrame:
    return counterfactual_panel(m, assignments, donor_sets, "month", cols)


def daily_panel(m: DataFrame, assignments: DataFrame, donor_sets: DataFrame | None = None,
                cols: PanelCols = HOUSE) -> DataFrame:
    return counterfactual_panel(m, assignments, donor_sets, "day", cols)


def long_panel(panel: DataFrame) -> DataFrame:
    """``treated_id, date, station_id, x, y, is_pre``: one row per donor and date."""
    return panel.select("treated_id", "date", "y", "is_pre", F.explode("donors").alias("d")).select(
        "treated_id", "date", F.col("d.id").alias("station_id"), F.col("d.x").alias("x"), "y", "is_pre"
    )


def panel_problems(panel: DataFrame, assignments: DataFrame, min_pre: int = 1) -> DataFrame:
    """``treated_id, problem`` for units that cannot be fitted; empty when all is well."""
    sizes = panel.groupBy("treated_id").agg(
        F.count(F.lit(1)).alias("n_dates"), F.count_if("is_pre").alias("n_pre")
    )
    units = assignments.groupBy("treated_id").agg(F.count(F.lit(1)).alias("n_roles"))
    return units.join(sizes, "treated_id", "left").select(
        "treated_id",
        F.when(F.col("n_roles") > 1, F.lit("assigned more than once"))
        .when(F.col("n_dates").isNull(), F.lit("no complete date: unit absent, or no common dates"))
        .when(F.col("n_pre") < min_pre, F.concat(
            F.lit(f"fewer than {min_pre} complete dates before the start: "), F.col("n_pre").cast("string")))
        .alias("problem"),
    ).filter(F.col("problem").isNotNull())


def require_fittable(panel: DataFrame, assignments: DataFrame, min_pre: int = 1) -> None:
    """Raise for the first unit (by id) that cannot be fitted."""
    bad = panel_problems(panel, assignments, min_pre).orderBy("treated_id").first()
    if bad is not None:
        raise ValueError(f"treated unit {bad.treated_id!r}: {bad.problem}")


def limiting_donors(m: DataFrame, grain: str = "month", cols: PanelCols = HOUSE) -> DataFrame:
    """Per station, the number of panel dates that only this station lacks.

    A date must be complete, so one short donor shrinks the whole panel; these
    are the dates won back by leaving the station out. A date carries only the
    count and the combined fingerprint of its stations; where one is absent, the
    difference to the fingerprint of all stations is that station's own.
    """
    mark = {"_f": F.xxhash64("station_id"), "_g": F.xxhash64(F.lit("second"), "station_id")}
    series = _series(m, grain, cols)
    stations = series.select("station_id").distinct().withColumns(mark)
    total = [stations.select(e).scalar() for e in (F.count(F.lit(1)), F.bit_xor("_f"), F.bit_xor("_g"))]
    lacking = (
        series.filter(F.col("x").isNotNull()).withColumns(mark).groupBy("date")
        .agg(F.count(F.lit(1)).alias("_k"), F.bit_xor("_f").alias("_f"), F.bit_xor("_g").alias("_g"))
        .filter(F.col("_k") == total[0] - 1)
        .select(F.col("_f").bitwiseXOR(total[1]).alias("_f"), F.col("_g").bitwiseXOR(total[2]).alias("_g"))
    )
    return (
        lacking.groupBy("_f", "_g").agg(F.count(F.lit(1)).alias("n_dates"))
        .join(stations, ["_f", "_g"]).select(F.col("station_id").alias(cols.id), "n_dates")
    )


def with_folds(panel: DataFrame, k: int = 5, key: str = "treated_id") -> DataFrame:
    """Contiguous validation folds over the dates before the start; null afterwards.

    The first ``n mod k`` folds hold one extra date.
    """
    unit = Window.partitionBy(key)
    n = F.count_if("is_pre").over(unit)
    at = F.row_number().over(unit.orderBy("date")) - 1
    small = F.floor(n / k)
    extra = n % k
    wide_rows = extra * (small + 1)
    fold = F.when(at < wide_rows, F.floor(at / (small + 1))).otherwise(
        extra + F.floor((at - wide_rows) / F.greatest(small, F.lit(1)))
    )
    return panel.withColumns({
        "n_pre": n.cast("long"), "fold": F.when(F.col("is_pre"), fold.cast("int")),
    })


def expanding_splits(panel: DataFrame, n_splits: int = 5) -> DataFrame:
    """Rolling-origin folds: ``split`` is the fold that tests a date, null if none does.

    Fold i is trained on every earlier pre-start date. The last
    ``n_splits * (n // (n_splits + 1))`` pre-start dates are tested.
    """
    unit = Window.partitionBy("treated_id")
    n = F.count_if("is_pre").over(unit)
    at = F.row_number().over(unit.orderBy("date")) - 1
    size = F.floor(n / (n_splits + 1))
    first = n - n_splits * size
    split = F.when((at >= first) & (size > 0), F.floor((at - first) / F.greatest(size, F.lit(1))))
    return panel.withColumn("split", F.when(F.col("is_pre"), split.cast("int")))


CALENDAR_FEATURES = ("month", "dow", "month_sin", "month_cos", "dow_sin", "dow_cos")
SEASON_FEATURES = ("month_sin", "month_cos", "trend")


def design_daily(panel: DataFrame, calendar: bool = True) -> DataFrame:
    """Daily panel plus month, weekday (Monday = 0) and their cyclic encodings."""
    if not calendar:
        return panel
    month, dow = F.month("date"), F.weekday("date")
    return panel.withColumns({
        "month": month, "dow": dow,
        "month_sin": cycle_sin(month, 12), "month_cos": cycle_cos(month, 12),
        "dow_sin": cycle_sin(dow, 7), "dow_cos": cycle_cos(dow, 7),
    })


def _calendar_classes(series: DataFrame, assignments: DataFrame, all_donors: bool):
    """Units with their own months, and one row per donor set and distinct set of months, led by its smallest unit."""
    sets = assignments.withColumn("donor_set", F.lit("all")) if all_donors else assignments
    own = series.join(sets, F.col("station_id") == F.col("treated_id"))
    units = own.groupBy("treated_id", "donor_set").agg(
        *[F.max(d).alias(d) for d in _DATES], F.sort_array(F.collect_list(F.struct("date", F.col("x").alias("y")))).alias("own"),
    ).withColumn("months", F.col("own.date"))
    return units, units.groupBy("donor_set", "months").agg(F.min("treated_id").alias("leader"))


def _class_donors(series: DataFrame, classes: DataFrame, donor_sets: DataFrame | None) -> DataFrame:
    """``leader, at, id, x``: every donor of a class at every position of its months, filled by position."""
    if donor_sets is None:
        donors = series.withColumn("donor_set", F.lit("all"))
    else:
        donors = series.join(donor_sets.select("donor_set", "station_id").distinct(), "station_id")
    placed = classes.select("donor_set", "leader", F.size("months").alias("n"), F.posexplode("months").alias("p", "date"))
    one = Window.partitionBy("leader", "id").orderBy("p")
    known = placed.join(donors, ["donor_set", "date"]).select(
        "leader", "n", (F.col("p") + 1).alias("p"), F.col("station_id").alias("id"), "x",
    ).withColumns({"next_p": F.lead("p").over(one), "next_x": F.lead("x").over(one), "is_first": F.lag("p").over(one).isNull()})
    since = F.when(F.col("is_first"), F.lit(1)).otherwise(F.col("p"))
    until = F.coalesce(F.col("next_p") - 1, F.col("n"))
    return known.withColumn("at", F.explode(F.sequence(since, until))).select("leader", "at", "id", F.when(
        (F.col("at") <= F.col("p")) | F.col("next_p").isNull(), F.col("x")
    ).otherwise(F.col("x") + (F.col("next_x") - F.col("x")) * (F.col("at") - F.col("p")) / (F.col("next_p") - F.col("p"))).alias("x"))


def design_monthly(m: DataFrame, assignments: DataFrame, donor_sets: DataFrame | None = None,
                   low=None, high=None, cols: PanelCols = HOUSE) -> DataFrame:
    """Monthly panel on the treated unit's months, donor gaps filled by position, with season and trend.

    Unlike the complete-case panel, a donor gap does not remove a month; donors
    without any value on these months are left out. A known value fills the
    positions up to the next one, the first also those before it. Filling depends
    on the months alone, so donors are filled once for all units with the same months.
    """
    series = _series(m, "month", cols).filter("x IS NOT NULL")
    if low is not None:
        series = series.filter(F.col("date").between(as_date(low), as_date(high)))
    units, classes = _calendar_classes(series, assignments, donor_sets is None)
    donors = _class_donors(series, classes, donor_sets).groupBy("leader", "at").agg(
        F.sort_array(F.collect_list(F.struct("id", "x"))).alias("donors"))
    own = units.join(classes, ["donor_set", "months"]).select("treated_id", "leader", *_DATES, F.posexplode("own").alias("trend", "o"))
    rows = own.withColumn("at", F.col("trend") + 1).join(donors, ["leader", "at"], "left")
    month, others = F.month("date"), F.filter("donors", lambda d: d["id"] != F.col("treated_id"))
    return rows.select(
        "treated_id", "o.*", *_DATES, F.coalesce(others, F.array().cast("array<struct<id:string,x:double>>")).alias("donors"),
        F.col("trend").cast("long").alias("trend"),
    ).withColumns({
        "is_pre": F.col("date") < F.col("start"),
        "month_sin": cycle_sin(month, 12), "month_cos": cycle_cos(month, 12),
    })
