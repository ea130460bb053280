"""Aggregations over panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcf.functions import calendar
from panelcf.functions.columns import as_date
from panelcf.operators import describe, quality, zones
from panelcf.operators.effects import capitalised
from panelcf.operators.impute import interpolate_position, interpolate_time
from panelcf.operators.panel import limiting_donors
from panelcf.plans.prepare import prepare
from panelcf.registry.book import query, rounded
from panelcf.registry.panels import (
    EVENT_START, EVENT_WINDOW, START, described, first_id, p_onation, p_segment, p_snation, p_supp,
    p_type, p_user, table, with_sql,
)
from panelcf.registry.reading import AREAS_SQL, IN_ZONE_SQL, META_SQL, area_meta, raw_export, zone_features

_PRE, _POST = "date < DATE '1999-01-01'", "date >= DATE '1999-01-01'"


@query("a1_zone_meta", with_sql(more=f"{AREAS_SQL}, {META_SQL}") + "SELECT * FROM meta")
def a1(spark, sf_dir):
    return area_meta(spark, sf_dir)


def _mode_sql(column: str) -> str:
    return (
        f"(SELECT station_id, {column} FROM (SELECT station_id, {column}, row_number() OVER "
        f"(PARTITION BY station_id ORDER BY count(*) DESC, {column}) AS rn FROM described "
        f"WHERE {column} IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)"
    )


def _first_sql(column: str, keys: str = "station_id") -> str:
    return (
        f"(SELECT {keys}, min({{'d': date, 'v': {column}}}).v AS {column} FROM described "
        f"WHERE {column} IS NOT NULL GROUP BY ALL)"
    )


@query("a2_station_meta", with_sql("described") + f"""
    SELECT * FROM {_mode_sql("station_name")} JOIN {_mode_sql("station_env")} USING (station_id)
    JOIN {_mode_sql("station_influence")} USING (station_id)
    LEFT JOIN {_first_sql("lat")} USING (station_id) LEFT JOIN {_first_sql("lon")} USING (station_id)""")
def a2(spark, sf_dir):
    return zones.station_meta(described(spark, sf_dir))


_BY_NAME = "station_id, station_name, station_env, station_influence"


@query("a2b_station_meta_by_name", with_sql("described") + f"""
    SELECT {_BY_NAME}, lat, lon FROM
        (SELECT DISTINCT {_BY_NAME} FROM described WHERE station_env IS NOT NULL)
        LEFT JOIN {_first_sql("lat", _BY_NAME)} USING ({_BY_NAME})
        LEFT JOIN {_first_sql("lon", _BY_NAME)} USING ({_BY_NAME})""")
def a2b(spark, sf_dir):
    return zones.station_meta_by_name(described(spark, sf_dir))


@query("a3_daily_mean", with_sql("p_supp") + "SELECT station_id, date, round(value + 3e-7, 4) AS value FROM p_supp")
def a3(spark, sf_dir):
    return rounded(p_supp(spark, sf_dir), 4)


def monthly_sql(panel: str) -> str:
    return (
        f"monthly AS (SELECT station_id, CAST(date_trunc('month', date) AS DATE) AS date, avg(value) AS value, "
        f"count(value) AS n_values FROM {panel} GROUP BY 1, 2)"
    )


_MONTH_GRID = """grid AS (
    SELECT station_id, CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS date
    FROM (SELECT station_id, CAST(min(date) AS TIMESTAMP) AS lo, CAST(max(date) AS TIMESTAMP) AS hi FROM monthly GROUP BY 1))"""


@query("a4_monthly_mean", with_sql("p_supp", more=f"{monthly_sql('p_supp')}, {_MONTH_GRID}") + """
    SELECT station_id, date, round(value + 3e-9, 6) AS value FROM grid LEFT JOIN monthly USING (station_id, date)""")
def a4(spark, sf_dir):
    return rounded(describe.monthly_mean(p_supp(spark, sf_dir), with_empty=True))


@query("a4b_monthly_mean_min_days", with_sql("p_onation", more=monthly_sql("p_onation")) + """
    SELECT station_id, date, round(CASE WHEN n_values >= 10 THEN value END + 3e-9, 6) AS value, n_values FROM monthly""")
def a4b(spark, sf_dir):
    return rounded(describe.monthly_mean(p_onation(spark, sf_dir), min_days=10))


_DAY_GRID = """spans AS (SELECT station_id, min(date) AS lo, max(date) AS hi FROM holed GROUP BY 1),
    grid AS (SELECT station_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM spans),
    days AS (SELECT station_id, date, value FROM grid LEFT JOIN holed USING (station_id, date))"""
_HOLED = """holed AS (SELECT station_id, date, CASE WHEN (CAST(station_id AS BIGINT) + day(date)) % 9 <> 0
    AND CAST(station_id AS BIGINT) % 14 <> 5 THEN value END AS value FROM p_user)"""


def holed(spark, sf_dir):
    """Daily event panel with additional null values, some series entirely null."""
    k = F.col("station_id").cast("bigint")
    return p_user(spark, sf_dir).withColumn(
        "value", F.when(((k + F.day("date")) % 9 != 0) & (k % 14 != 5), F.col("value")))


@query("j2_complete_calendar", with_sql("p_user", more=f"{_HOLED}, {_DAY_GRID}") + """
    SELECT station_id, date, round(value + 3e-9, 6) AS value FROM days""")
def j2(spark, sf_dir):
    return rounded(quality.complete_calendar(holed(spark, sf_dir)))


@query("j2_complete_calendar_nations", with_sql("p_snation", more=f"holed AS (SELECT * FROM p_snation), {_DAY_GRID}") + """
    SELECT station_id, date, round(value + 3e-7, 4) AS value FROM days""")
def j2_nations(spark, sf_dir):
    return rounded(quality.complete_calendar(p_snation(spark, sf_dir)), 4)


@query("a5_missing_summary", with_sql("p_user", more=f"{_HOLED}, {_DAY_GRID}") + """
    SELECT station_id, count(*) - count(value) AS missing_days, count(*) AS n_days,
           min(date) AS date_min, max(date) AS date_max FROM days GROUP BY 1""")
def a5(spark, sf_dir):
    return quality.missing_summary(holed(spark, sf_dir))


@query("a6_missing_ratio_kept", with_sql("p_user", more=f"{_HOLED}, {_DAY_GRID}") + """
    SELECT station_id, date FROM holed WHERE station_id IN (
        SELECT station_id FROM days GROUP BY 1 HAVING (count(*) - count(value)) / count(*) <= 0.2)""")
def a6(spark, sf_dir):
    return quality.missing_ratio(holed(spark, sf_dir), 0.2)[0].select("station_id", "date")


@query("a6_missing_ratio_dropped", with_sql("p_user", more=f"holed AS (SELECT * FROM p_user), {_DAY_GRID}") + """
    SELECT station_id, round((count(*) - count(value)) / count(*) + 3e-9, 6) AS missing_ratio FROM days GROUP BY 1
    HAVING (count(*) - count(value)) / count(*) > 0.09""")
def a6_dropped(spark, sf_dir):
    return rounded(quality.missing_ratio(p_user(spark, sf_dir), 0.09)[1])


@query("w2_gap_intervals", with_sql("p_user", more=f"{_HOLED}, {_DAY_GRID}") + """
    SELECT station_id, min(date) AS gap_start, max(date) AS gap_end, count(*) AS gap_length_days FROM (
        SELECT station_id, date, date - CAST(row_number() OVER (PARTITION BY station_id ORDER BY date) AS INTEGER) AS island
        FROM days WHERE value IS NULL) GROUP BY station_id, island""")
def w2(spark, sf_dir):
    return quality.gap_intervals(holed(spark, sf_dir))


@query("w2_gap_intervals_nations", with_sql("p_snation", more=f"holed AS (SELECT * FROM p_snation), {_DAY_GRID}") + """
    SELECT station_id, min(date) AS gap_start, max(date) AS gap_end, count(*) AS gap_length_days FROM (
        SELECT station_id, date, date - CAST(row_number() OVER (PARTITION BY station_id ORDER BY date) AS INTEGER) AS island
        FROM days WHERE value IS NULL) GROUP BY station_id, island""")
def w2_nations(spark, sf_dir):
    return quality.gap_intervals(p_snation(spark, sf_dir))


@query("w6_gap_edges", with_sql("p_user", more=f"{_HOLED}, {_DAY_GRID}") + """
    SELECT station_id, date, value IS NULL AS is_missing,
           lag(value IS NULL, 1, false) OVER (PARTITION BY station_id ORDER BY date) AS missing_before,
           lead(value IS NULL, 1, false) OVER (PARTITION BY station_id ORDER BY date) AS missing_after FROM days""")
def w6(spark, sf_dir):
    return quality.gap_edges(holed(spark, sf_dir)).drop("value")


def _period_sql(name: str, condition: str) -> str:
    return f"""SELECT station_id, '{name}' AS period, round(avg(value) + 3e-9, 6) AS mean, round(median(value) + 3e-9, 6) AS median,
        round(stddev_samp(value) + 3e-9, 6) AS std, round(quantile_cont(value, 0.1) + 3e-9, 6) AS p10,
        round(quantile_cont(value, 0.9) + 3e-9, 6) AS p90, count(value) AS n_days
        FROM (SELECT station_id, CASE WHEN {condition} THEN value END AS value FROM p_user) GROUP BY 1"""


_EX = "date BETWEEN DATE '2024-01-20' AND DATE '2024-01-22'"


@query("a7_pre_post_summary", with_sql("p_user") + " UNION ALL ".join([
    _period_sql("pre", "date < DATE '2024-01-16'"), _period_sql("post", "date >= DATE '2024-01-16'"),
    _period_sql("post_ex", f"date >= DATE '2024-01-16' AND NOT {_EX}")]))
def a7(spark, sf_dir):
    return rounded(describe.pre_post_summary(p_user(spark, sf_dir), EVENT_START, EVENT_WINDOW))


_MONTH_PROFILE = """
    SELECT station_id, CAST(month AS INTEGER) AS month, round(mean_pre + 3e-9, 6) AS mean_pre, round(mean_post + 3e-9, 6) AS mean_post
    FROM (SELECT DISTINCT station_id FROM {panel}) CROSS JOIN (SELECT unnest(range(1, 13)) AS month) LEFT JOIN (
        SELECT station_id, month(date) AS month, avg(CASE WHEN date < DATE '{start}' THEN value END) AS mean_pre,
               avg(CASE WHEN date >= DATE '{start}' THEN value END) AS mean_post FROM {panel} GROUP BY 1, 2)
    USING (station_id, month)"""


@query("a8_month_profile", with_sql("p_snation") + _MONTH_PROFILE.format(panel="p_snation", start=START))
def a8(spark, sf_dir):
    return rounded(describe.month_profile(p_snation(spark, sf_dir), START))


@query("j3_month_spine", with_sql("p_user") + _MONTH_PROFILE.format(panel="p_user", start=EVENT_START))
def j3(spark, sf_dir):
    return rounded(describe.month_profile(p_user(spark, sf_dir), EVENT_START))


@query("a9_weekpart_profile", with_sql("p_snation") + "SELECT station_id, " + ", ".join(
    f"round(avg(CASE WHEN {p} AND isodow(date) {op} 6 THEN value END) + 3e-9, 6) AS {part}_{period}"
    for period, p in (("pre", _PRE), ("post", _POST)) for part, op in (("weekday", "<"), ("weekend", ">="))
) + " FROM p_snation GROUP BY 1")
def a9(spark, sf_dir):
    return rounded(describe.weekpart_profile(p_snation(spark, sf_dir), START))


_BOTH = f"""contrast AS (
    SELECT station_id, mean_pre, n_pre, mean_post, n_post, mean_post - mean_pre AS delta_post_pre FROM
        (SELECT station_id, avg(value) AS mean_pre, count(value) AS n_pre FROM {{panel}} WHERE {_PRE} GROUP BY 1)
        FULL JOIN (SELECT station_id, avg(value) AS mean_post, count(value) AS n_post FROM {{panel}} WHERE {_POST} GROUP BY 1)
        USING (station_id)
    WHERE n_pre >= {{least}} AND n_post >= {{least}})"""
_CONTRAST = """SELECT station_id, round(mean_pre + 3e-9, 6) AS mean_pre, n_pre, round(mean_post + 3e-9, 6) AS mean_post, n_post,
    round(delta_post_pre + 3e-9, 6) AS delta_post_pre FROM contrast"""


@query("a10_donor_contrast", with_sql("p_snation", more=_BOTH.format(panel="p_snation", least=30)) + _CONTRAST)
def a10(spark, sf_dir):
    return rounded(describe.donor_contrast(p_snation(spark, sf_dir), START))


@query("j4_pre_post_join", with_sql("p_supp", more=_BOTH.format(panel="p_supp", least=0)) + _CONTRAST)
def j4(spark, sf_dir):
    return rounded(describe.donor_contrast(p_supp(spark, sf_dir), START, 0, 0))


@query("a11_daily_levels", with_sql("p_snation") + f"""
    SELECT date, round(avg(CASE WHEN station_id = t THEN value END) + 3e-7, 4) AS treated,
           round(avg(CASE WHEN station_id <> t THEN value END) + 3e-7, 4) AS donors_mean
    FROM p_snation, (SELECT min(station_id) AS t FROM p_snation) WHERE {_PRE} GROUP BY 1""")
def a11(spark, sf_dir):
    m = p_snation(spark, sf_dir)
    return rounded(describe.daily_levels(m, first_id(m), START), 4)


_FENCES = """q AS (
    SELECT grp, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
    FROM points WHERE v IS NOT NULL GROUP BY 1),
  f AS (SELECT grp, v, q1, median, q3,
        v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM points JOIN q USING (grp) WHERE v IS NOT NULL)"""
_BOXES = """SELECT grp, round(q1 + 3e-9, 6) AS q1, round(median + 3e-9, 6) AS median, round(q3 + 3e-9, 6) AS q3,
    round(least(min(CASE WHEN inside THEN v END), q1) + 3e-9, 6) AS whisker_low,
    round(greatest(max(CASE WHEN inside THEN v END), q3) + 3e-9, 6) AS whisker_high,
    count(*) FILTER (NOT inside) AS n_outliers, count(*) AS n FROM f GROUP BY grp, f.q1, f.median, f.q3"""


@query("a12_box_stats", f"WITH points AS (SELECT event_type AS grp, value AS v FROM events), {_FENCES} " + _BOXES)
def a12(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("grp"), F.col("value").alias("v"))
    return rounded(describe.box_stats(points, "grp", "v"))


@query("a12_box_outliers", f"WITH points AS (SELECT event_type AS grp, value AS v FROM events), {_FENCES} "
       "SELECT grp, v FROM f WHERE NOT inside")
def a12_outliers(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("grp"), F.col("value").alias("v"))
    return describe.box_outliers(points, "grp", "v")


@query("a12_box_stats_levels", with_sql("p_snation", more=f"""
    points AS (SELECT CASE WHEN station_id = t THEN 'treated' ELSE 'donors' END AS grp, avg(value) AS v
        FROM p_snation, (SELECT min(station_id) AS t FROM p_snation) WHERE {_PRE} GROUP BY 1, date), {_FENCES}""")
       + _BOXES.replace("3e-9, 6)", "3e-7, 4)"))
def a12_levels(spark, sf_dir):
    m = p_snation(spark, sf_dir)
    levels = describe.daily_levels(m, first_id(m), START).unpivot(
        "date", [F.col("treated"), F.col("donors_mean").alias("donors")], "grp", "v")
    return rounded(describe.box_stats(levels, "grp", "v"), 4)


@query("a13_delta_ranking", with_sql("p_snation", more=_BOTH.format(panel="p_snation", least=30)) + """
    SELECT station_id, round(delta_post_pre + 3e-9, 6) AS delta_post_pre, round(d + 3e-9, 6) AS treated_delta
    FROM contrast, (SELECT min(station_id) AS t FROM p_snation), (SELECT station_id AS o, delta_post_pre AS d FROM contrast)
    WHERE o = t AND station_id <> t""")
def a13(spark, sf_dir):
    m = p_snation(spark, sf_dir)
    return rounded(describe.delta_ranking(describe.donor_contrast(m, START), first_id(m)))


def _corr_sql(panel: str, pre: str, treated: str) -> str:
    return with_sql(panel) + f"""
    SELECT a.station_id AS treated_id, b.station_id, round(corr(a.value, b.value) + 3e-9, 6) AS corr, count(*) AS n_days
    FROM {panel} a JOIN {panel} b ON a.date = b.date AND a.station_id <> b.station_id
    WHERE a.{pre} AND a.value IS NOT NULL AND b.value IS NOT NULL {treated} GROUP BY 1, 2
    HAVING corr(a.value, b.value) IS NOT NULL AND NOT isnan(corr(a.value, b.value))"""


@query("a14_pre_correlations", _corr_sql(
    "p_snation", _PRE, "AND a.station_id = (SELECT min(station_id) FROM p_snation)"))
def a14(spark, sf_dir):
    m = p_snation(spark, sf_dir)
    return rounded(describe.pre_correlations(m, first_id(m), START))


@query("a14_pre_correlations_all", _corr_sql("p_snation", _PRE, ""))
def a14_all(spark, sf_dir):
    m = p_snation(spark, sf_dir)
    ids = [r.station_id for r in m.select("station_id").distinct().collect()]  # nations
    return rounded(describe.pre_correlations(m, ids, START))


@query("a14_pre_correlations_events", _corr_sql("p_type", "date < DATE '2024-01-16'", ""))
def a14_events(spark, sf_dir):
    m = p_type(spark, sf_dir)
    ids = [r.station_id for r in m.select("station_id").distinct().collect()]
    return rounded(describe.pre_correlations(m, ids, EVENT_START))


_SQL_IDS = range(25)  # columns of the check SQL, which has to name them


def nation_ids(spark, sf_dir) -> list[str]:
    """The station ids of the panel by nation, one for each row of ``nation``."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).orderBy("k").collect()
    return [str(r.k) for r in rows]


@query("a16_to_wide", with_sql("p_onation") + "SELECT date, " + ", ".join(
    f"round(avg(CASE WHEN station_id = '{i}' THEN value END) + 3e-7, 4) AS s{i}" for i in _SQL_IDS) + " FROM p_onation GROUP BY 1")
def a16(spark, sf_dir):
    ids = nation_ids(spark, sf_dir)
    return rounded(describe.to_wide(p_onation(spark, sf_dir), ids).withColumnsRenamed({i: f"s{i}" for i in ids}), 4)


@query("a17_to_long", with_sql("p_onation") + """
    SELECT station_id, date, round(value + 3e-7, 4) AS value FROM p_onation""")
def a17(spark, sf_dir):
    return rounded(describe.to_long(describe.to_wide(p_onation(spark, sf_dir), nation_ids(spark, sf_dir))), 4)


_SPARSE = monthly_sql("p_onation") + """,
    sparse AS (SELECT station_id, date, CASE WHEN n_values >= 10 THEN value END AS value FROM monthly),
    lacking AS (SELECT station_id, (SELECT count(DISTINCT date) FROM sparse) - count(value) AS missing_periods
                FROM sparse GROUP BY 1)"""


def sparse_months(spark, sf_dir):
    return describe.monthly_mean(p_onation(spark, sf_dir), min_days=10).drop("n_values")


@query("a18_missing_periods", with_sql("p_onation", more=_SPARSE) + "SELECT * FROM lacking")
def a18(spark, sf_dir):
    return quality.missing_periods(sparse_months(spark, sf_dir))


@query("a18_keep_stations", with_sql("p_onation", more=_SPARSE) + """
    SELECT station_id, date FROM sparse WHERE station_id IN (SELECT station_id FROM lacking WHERE missing_periods <= 78)""")
def a18_kept(spark, sf_dir):
    return quality.keep_stations(sparse_months(spark, sf_dir), 78).select("station_id", "date")


@query("w1_rolling_mean", with_sql("p_user") + """
    SELECT station_id, date, round(value + 3e-9, 6) AS value, round(avg(value) OVER (PARTITION BY station_id ORDER BY date
           ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) + 3e-9, 6) AS smooth FROM p_user""")
def w1(spark, sf_dir):
    return rounded(describe.rolling_mean(p_user(spark, sf_dir)))


@query("w1_rolling_mean_week", with_sql("p_segment") + """
    SELECT station_id, date, round(avg(value) OVER (PARTITION BY station_id ORDER BY date
           ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + 3e-7, 4) AS smooth FROM p_segment""")
def w1_week(spark, sf_dir):
    return rounded(describe.rolling_mean(p_segment(spark, sf_dir), 7).drop("value"), 4)


def _fill_sql(grid: str, at: str, digits: int, keys: str = "station_id") -> str:
    before = f"OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""sided AS (SELECT *,
        last_value(value IGNORE NULLS) {before} AS y0, last_value(CASE WHEN value IS NOT NULL THEN {at} END IGNORE NULLS) {before} AS t0,
        first_value(value IGNORE NULLS) {after} AS y1, first_value(CASE WHEN value IS NOT NULL THEN {at} END IGNORE NULLS) {after} AS t1
        FROM {grid}),
      filled AS (SELECT {keys}, date, round(coalesce(value, y0 + (y1 - y0) * ({at} - t0) / (t1 - t0), y0, y1) + 3e-{digits + 3}, {digits}) AS value FROM sided)"""


@query("w3_interpolate_time", with_sql("p_user", more=f"""{_HOLED}, {_DAY_GRID},
    good AS (SELECT *, CAST(date - DATE '2000-01-01' AS BIGINT) AS t FROM days WHERE station_id IN (
        SELECT station_id FROM days GROUP BY 1 HAVING (count(*) - count(value)) / count(*) <= 0.2)),
    {_fill_sql("good", "t", 6)}""") + "SELECT * FROM filled")
def w3(spark, sf_dir):
    return rounded(interpolate_time(holed(spark, sf_dir), 0.2)[0])


@query("w3_interpolate_time_all", with_sql("p_snation", more=f"""holed AS (SELECT * FROM p_snation), {_DAY_GRID},
    good AS (SELECT *, CAST(date - DATE '1990-01-01' AS BIGINT) AS t FROM days), {_fill_sql("good", "t", 3)}""") + """
    SELECT * FROM filled""")
def w3_all(spark, sf_dir):
    return rounded(interpolate_time(p_snation(spark, sf_dir), 1.0)[0], 3)


@query("w4_interpolate_position", with_sql("p_onation", more=_SPARSE + """,
    grid AS (SELECT station_id, date, value, row_number() OVER (PARTITION BY station_id ORDER BY date) AS t
             FROM (SELECT DISTINCT station_id FROM sparse) CROSS JOIN (SELECT DISTINCT date FROM sparse)
             LEFT JOIN sparse USING (station_id, date)), """ + _fill_sql("grid", "t", 6)) + "SELECT * FROM filled")
def w4(spark, sf_dir):
    return rounded(interpolate_position(sparse_months(spark, sf_dir)))


@query("w5_trend_index", with_sql("p_supp", more=monthly_sql("p_supp")) + """
    SELECT station_id, date, row_number() OVER (PARTITION BY station_id ORDER BY date) - 1 AS trend FROM monthly""")
def w5(spark, sf_dir):
    return quality.trend_index(describe.monthly_mean(p_supp(spark, sf_dir)).drop("value"))


@query("q13_limiting_donors", with_sql("p_segment") + """
    , s AS (SELECT DISTINCT station_id FROM p_segment),
    cells AS (SELECT s.station_id, d.date, p.value IS NULL AS lacks FROM s
              CROSS JOIN (SELECT DISTINCT date FROM p_segment) d LEFT JOIN p_segment p ON p.station_id = s.station_id AND p.date = d.date)
    SELECT station_id, count(*) AS n_dates FROM cells WHERE lacks
        AND date IN (SELECT date FROM cells GROUP BY 1 HAVING count(*) FILTER (lacks) = 1) GROUP BY 1""")
def limiting(spark, sf_dir):
    return limiting_donors(p_segment(spark, sf_dir), "day")


@query("f_scalar_functions", """
    SELECT o_orderkey, CAST(month(d) AS INTEGER) AS month, CAST(isodow(d) - 1 AS INTEGER) AS dow, isodow(d) >= 6 AS weekend,
           CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(d - DATE '1995-01-01' + 1 AS INTEGER) AS days,
           round(sin(2 * pi() * month(d) / 12) + 3e-9, 6) AS month_sin, round(cos(2 * pi() * (isodow(d) - 1) / 7) + 3e-9, 6) AS dow_cos,
           round(pow(10, -3 + (o_orderkey % 50) * 6 / 49) + 3e-9, 6) AS alpha,
           upper(o_orderpriority[3]) || lower(o_orderpriority[4:]) AS priority, contains(lower(o_orderpriority), 'high') AS is_high
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def scalars(spark, sf_dir):
    day, month, dow = F.to_date("o_orderdate"), F.month("o_orderdate"), F.weekday("o_orderdate")
    orders = table(spark, sf_dir, "orders").withColumn("word", F.substring("o_orderpriority", F.lit(3), F.length("o_orderpriority")))
    return rounded(orders.select(
        "o_orderkey", month.alias("month"), dow.alias("dow"), calendar.is_weekend(day).alias("weekend"),
        calendar.month_start(day).alias("month_start"), calendar.days_spanned(as_date("1995-01-01"), day).alias("days"),
        calendar.cycle_sin(month, 12).alias("month_sin"), calendar.cycle_cos(dow, 7).alias("dow_cos"),
        calendar.log_grid(-3, 3, 50)[(F.col("o_orderkey") % 50).cast("int")].alias("alpha"),
        capitalised("word").alias("priority"), F.contains(F.lower("o_orderpriority"), F.lit("high")).alias("is_high")))


_EXPORTED = """holed AS (SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS date,
    avg(CASE WHEN event_id % 11 <> 0 THEN value END) AS value FROM events GROUP BY 1, 2)"""


@query("e2_prepared_panel", f"""WITH {_EXPORTED}, {_DAY_GRID},
    good AS (SELECT *, CAST(date - DATE '2000-01-01' AS BIGINT) AS t FROM days WHERE station_id IN (
        SELECT station_id FROM days GROUP BY 1 HAVING (count(*) - count(value)) / count(*) <= 0.2)),
    {_fill_sql("good", "t", 6)}
    SELECT station_id, date, value, 'Station ' || station_id AS station_name, 'NATION_12' AS zone FROM filled""")
def e2(spark, sf_dir):
    done = prepare(raw_export(spark, sf_dir), zone_features(spark, sf_dir), "NATION_12", 0.2)
    return rounded(done.filled.select("station_id", "date", "value", "station_name", "zone"))


@query("e2_flagged_stations", """
    WITH first AS (SELECT CAST(user_id AS VARCHAR) AS station_id,
            min({'d': CAST(ts AS DATE), 'v': CAST(event_id % 90 AS DOUBLE)}).v AS lat,
            min({'d': CAST(ts AS DATE), 'v': CAST(event_id % 180 AS DOUBLE)}).v AS lon FROM events GROUP BY 1),
         moved AS (SELECT *, lon - (14 * 12 - 180) AS dx, lat - (5 * 12 - 65) AS dy FROM first)
    SELECT station_id, lat, lon, """ + IN_ZONE_SQL + " AS in_zone FROM moved")
def e2_stations(spark, sf_dir):
    done = prepare(raw_export(spark, sf_dir), zone_features(spark, sf_dir), "NATION_12")
    return done.stations.select("station_id", "lat", "lon", "in_zone")
