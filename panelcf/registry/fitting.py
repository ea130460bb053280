"""Counterfactual panels, fits and effects."""

from __future__ import annotations

from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcf.operators import effects, panel as panels, pool as pools, synth, trees
from panelcf.operators.impute import interpolate_time
from panelcf.plans.evaluate import evaluate, evaluate_trees
from panelcf.registry.book import query, rounded
from panelcf.registry.describing import monthly_sql, sparse_months
from panelcf.registry.panels import (
    EVENT_START, EVENT_WINDOW, START, WINDOW, described, first_id, p_onation, p_segment, p_snation, p_type, with_sql,
)
from panelcf.session import shared_dir
from panelcf.sources.tables import stored

# --- panels ------------------------------------------------------------------

# Months (days) on which all stations have a value, for every treated station.
_LONG = """
    n AS (SELECT count(DISTINCT station_id) AS n FROM {src}),
    full_dates AS (SELECT date FROM {src} GROUP BY date HAVING count(value) = (SELECT n FROM n)),
    cells AS (SELECT t.station_id AS treated_id, t.date, d.station_id, d.value AS x, t.value AS y, t.date < DATE '{start}' AS is_pre
              FROM {src} t JOIN {src} d ON t.date = d.date AND t.station_id <> d.station_id
              WHERE t.date IN (SELECT date FROM full_dates))"""
_LONG_OUT = """SELECT treated_id, date, station_id, round(x + 3e-6, 3) AS x, round(y + 3e-6, 3) AS y, is_pre FROM cells"""

SNATION_CELLS = with_sql("p_snation", more=monthly_sql("p_snation") + "," + _LONG.format(src="monthly", start=START))
SEGMENT_CELLS = with_sql("p_segment", more=_LONG.format(src="p_segment", start=START))
TYPE_CELLS = with_sql("p_type", more=_LONG.format(src="p_type", start=EVENT_START))


def snation_months(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every supplier nation treated once, on monthly means."""
    m = p_snation(spark, sf_dir)
    units = panels.assign_all(m, START, WINDOW)
    return panels.monthly_panel(m, units), units


def segment_days(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = p_segment(spark, sf_dir)
    units = panels.assign_all(m, START, WINDOW)
    return panels.daily_panel(m, units), units


@query("m1_monthly_panel", SNATION_CELLS + _LONG_OUT)
def m1(spark, sf_dir):
    return rounded(panels.long_panel(snation_months(spark, sf_dir)[0]), 3)


@query("m2_daily_panel", SEGMENT_CELLS + _LONG_OUT)
def m2(spark, sf_dir):
    return rounded(panels.long_panel(segment_days(spark, sf_dir)[0]), 3)


@query("m2_daily_panel_donor_sets", with_sql("p_type", more="""
    sets AS (SELECT DISTINCT CASE WHEN station_id < 'l' THEN 'early' ELSE 'late' END AS donor_set, station_id FROM p_type),
    treated AS (SELECT DISTINCT station_id AS treated_id,
                CASE WHEN station_id < 'l' THEN 'late' ELSE 'early' END AS donor_set FROM p_type)""") + """
    SELECT treated_id, t.date, d.station_id, round(d.value + 3e-9, 6) AS x, round(t.value + 3e-9, 6) AS y,
           t.date < DATE '2024-01-16' AS is_pre
    FROM treated JOIN p_type t ON t.station_id = treated_id JOIN sets USING (donor_set)
    JOIN p_type d ON d.station_id = sets.station_id AND d.date = t.date""")
def m2_sets(spark, sf_dir):
    m = p_type(spark, sf_dir)
    early = F.col("station_id") < "l"
    names = m.select("station_id").distinct()
    sets = names.select(F.when(early, F.lit("early")).otherwise(F.lit("late")).alias("donor_set"), "station_id")
    units = panels.assign_all(m, EVENT_START, EVENT_WINDOW).withColumn(
        "donor_set", F.when(F.col("treated_id") < "l", F.lit("late")).otherwise(F.lit("early")))
    return rounded(panels.long_panel(panels.daily_panel(m, units, sets)))


@query("j5_treated_with_donors", TYPE_CELLS + """
    SELECT treated_id, date, round(any_value(y) + 3e-9, 6) AS y, count(*) AS n_donors, round(sum(x) + 3e-9, 6) AS x_sum
    FROM cells GROUP BY 1, 2""")
def j5(spark, sf_dir):
    m = p_type(spark, sf_dir)
    joined = panels.daily_panel(m, panels.assign_all(m, EVENT_START, EVENT_WINDOW))
    return rounded(joined.select(
        "treated_id", "date", "y", F.size("donors").cast("bigint").alias("n_donors"),
        F.aggregate("donors", F.lit(0.0), lambda a, d: a + d["x"]).alias("x_sum")))


@query("m8_design_daily", SEGMENT_CELLS + """
    SELECT treated_id, date, month(date) AS month, isodow(date) - 1 AS dow,
           round(sin(2 * pi() * month(date) / 12) + 3e-9, 6) AS month_sin, round(cos(2 * pi() * month(date) / 12) + 3e-9, 6) AS month_cos,
           round(sin(2 * pi() * (isodow(date) - 1) / 7) + 3e-9, 6) AS dow_sin, round(cos(2 * pi() * (isodow(date) - 1) / 7) + 3e-9, 6) AS dow_cos,
           count(*) AS n_donors
    FROM cells GROUP BY 1, 2""")
def m8(spark, sf_dir):
    design = panels.design_daily(segment_days(spark, sf_dir)[0])
    return rounded(design.select(
        "treated_id", "date", F.col("month").cast("bigint").alias("month"), F.col("dow").cast("bigint").alias("dow"),
        *panels.CALENDAR_FEATURES[2:], F.size("donors").cast("bigint").alias("n_donors")))


_TREND_SQL = with_sql("p_onation", more=monthly_sql("p_onation") + """,
    sparse AS (SELECT station_id, date, value FROM monthly WHERE n_values >= 10),
    t AS (SELECT station_id AS treated_id, date, value AS y FROM sparse),
    grid AS (SELECT t.treated_id, d.station_id, t.date, m.value,
                    row_number() OVER (PARTITION BY t.treated_id, d.station_id ORDER BY t.date) AS t
             FROM t JOIN (SELECT DISTINCT station_id FROM sparse) d ON d.station_id <> t.treated_id
             LEFT JOIN sparse m ON m.station_id = d.station_id AND m.date = t.date),
    sided AS (SELECT *,
        last_value(value IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0,
        first_value(value IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1
        FROM grid WINDOW b AS (PARTITION BY treated_id, station_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         a AS (PARTITION BY treated_id, station_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT treated_id, station_id, date, coalesce(value, y0 + (y1 - y0) * (t - t0) / (t1 - t0), y0, y1) AS x FROM sided)""")


@query("m8b_design_monthly", _TREND_SQL + """
    SELECT treated_id, date, round(y + 3e-6, 3) AS y, round(sum_x + 3e-6, 3) AS x_sum, n_donors,
           round(sin(2 * pi() * month(date) / 12) + 3e-9, 6) AS month_sin, round(cos(2 * pi() * month(date) / 12) + 3e-9, 6) AS month_cos,
           row_number() OVER (PARTITION BY treated_id ORDER BY date) - 1 AS trend
    FROM t JOIN (SELECT treated_id, date, sum(x) AS sum_x, count(x) AS n_donors FROM filled WHERE x IS NOT NULL GROUP BY 1, 2)
    USING (treated_id, date)""")
def m8b(spark, sf_dir):
    months = sparse_months(spark, sf_dir).filter("value IS NOT NULL")
    units = panels.assign_all(months, START, WINDOW)
    design = panels.design_monthly(months, units)
    flat = design.select(
        "treated_id", "date", "y", F.aggregate("donors", F.lit(0.0), lambda a, d: a + d["x"]).alias("x_sum"),
        F.size("donors").cast("bigint").alias("n_donors"), "month_sin", "month_cos", "trend")
    return rounded(flat, 6, y=3, x_sum=3)


# --- folds -------------------------------------------------------------------


@query("m4_folds", SEGMENT_CELLS + """
    , pre AS (SELECT treated_id, date, row_number() OVER (PARTITION BY treated_id ORDER BY date) - 1 AS pos,
                     count(*) OVER (PARTITION BY treated_id) AS n
              FROM (SELECT DISTINCT treated_id, date FROM cells WHERE is_pre))
    SELECT treated_id, date, n AS n_pre, CAST(CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
           ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM pre""")
def folds(spark, sf_dir):
    tagged = panels.with_folds(segment_days(spark, sf_dir)[0])
    return tagged.filter("is_pre").select("treated_id", "date", "n_pre", "fold")


@query("m12_expanding_splits", SEGMENT_CELLS + """
    , pre AS (SELECT treated_id, date, row_number() OVER (PARTITION BY treated_id ORDER BY date) - 1 AS pos,
                     count(*) OVER (PARTITION BY treated_id) AS n
              FROM (SELECT DISTINCT treated_id, date FROM cells WHERE is_pre))
    SELECT treated_id, date, CAST(CASE WHEN pos >= n - 5 * (n // 6) THEN (pos - (n - 5 * (n // 6))) // (n // 6) END AS INTEGER) AS split
    FROM pre""")
def splits(spark, sf_dir):
    tagged = panels.expanding_splits(segment_days(spark, sf_dir)[0])
    return tagged.filter("is_pre").select("treated_id", "date", "split")


# --- fits against one donor, which SQL can repeat in full ----------------------


def one_donor_events(spark, sf_dir) -> DataFrame:
    """Daily event panel; every type but the donor is treated, the donor is the first type."""
    m = p_type(spark, sf_dir)
    donor = first_id(m)
    units = panels.assign_all(m, EVENT_START, EVENT_WINDOW).filter(F.col("treated_id") != donor)
    sets = spark.createDataFrame([("all", donor)], ["donor_set", "station_id"])
    return panels.daily_panel(m, units, sets)


_ONE = with_sql("p_type", more="""
    donor AS (SELECT min(station_id) AS id FROM p_type),
    rows AS (SELECT t.station_id AS treated_id, t.date, d.station_id, d.value AS x, t.value AS y,
                    row_number() OVER (PARTITION BY t.station_id ORDER BY t.date) - 1 AS pos,
                    count(*) OVER (PARTITION BY t.station_id) AS n
             FROM p_type t JOIN p_type d ON t.date = d.date JOIN donor ON d.station_id = donor.id AND t.station_id <> donor.id
             WHERE t.date < DATE '2024-01-16'),
    folded AS (SELECT *, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1)
                    ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM rows),
    ks AS (SELECT unnest(range(5)) AS k),
    train AS (SELECT treated_id, k, count(*) AS n, avg(x) AS mx, avg(y) AS my,
                     regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy
              FROM folded JOIN ks ON fold <> k GROUP BY 1, 2),
    whole AS (SELECT treated_id, any_value(station_id) AS station_id, count(*) AS n, avg(x) AS mx, avg(y) AS my,
                     regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM rows GROUP BY 1)""")


def _tuned_sql(method: str, grid: str, weight: str, score: str, order: str) -> str:
    """Cross-validated fit with one donor; ``weight`` uses n, sxx, sxy, a (alpha), r (ratio).

    Penalties that all give a zero weight have the same score; ``order`` compares scores above
    the noise of summation, so that such ties are decided by the tie rule.
    """
    return _ONE + f""",
    grid AS ({grid}),
    fits AS (SELECT treated_id, k, a, r, apos, rpos, {weight} AS w, my - ({weight}) * mx AS b FROM train CROSS JOIN grid),
    held AS (SELECT treated_id, k, a, r, apos, rpos, {score} AS score FROM fits JOIN folded USING (treated_id)
             WHERE fold = k GROUP BY ALL),
    means AS (SELECT treated_id, a, r, apos, rpos, avg(score) AS score FROM held GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY treated_id ORDER BY {order}) AS rn FROM means)
    SELECT treated_id, '{method}' AS method, station_id, round(a + 3e-9, 6) AS alpha, round(r + 3e-9, 6) AS l1_ratio,
           round({weight} + 3e-9, 6) AS weight, round(my - ({weight}) * mx + 3e-9, 6) AS intercept
    FROM best JOIN whole USING (treated_id) WHERE rn = 1"""


_R2 = "1 - sum((y - w * x - b) ** 2) / (var_pop(y) * count(*))"
_MSE = "avg((y - w * x - b) ** 2)"
_SOFT = "sign(sxy) * greatest(abs(sxy) - a * r * n, 0) / (sxx + a * (1 - r) * n)"


def _fit_columns(weights: DataFrame) -> DataFrame:
    return rounded(weights.select("treated_id", "method", "station_id", "alpha", "l1_ratio", "weight", "intercept"))


@query("m3_fit_ols", _ONE + """
    SELECT treated_id, 'ols' AS method, station_id, 0.0::DOUBLE + 3e-9 - 3e-9 AS alpha, 0.0::DOUBLE AS l1_ratio,
           round(sxy / sxx + 3e-9, 6) AS weight, round(my - sxy / sxx * mx + 3e-9, 6) AS intercept FROM whole""")
def m3(spark, sf_dir):
    return _fit_columns(synth.fit_scm(one_donor_events(spark, sf_dir), ["ols"], synth.DAILY))


@query("m3_fit_ols_two_donors", with_sql("p_type", more="""
    a AS (SELECT min(station_id) AS id FROM p_type),
    b AS (SELECT min(station_id) AS id FROM p_type WHERE station_id > (SELECT id FROM a)),
    rows AS (SELECT t.station_id AS treated_id, t.value AS y, u.value AS u, v.value AS v
             FROM p_type t JOIN p_type u ON u.date = t.date JOIN p_type v ON v.date = t.date
             WHERE u.station_id = (SELECT id FROM a) AND v.station_id = (SELECT id FROM b)
               AND t.station_id NOT IN (SELECT id FROM a UNION ALL SELECT id FROM b) AND t.date < DATE '2024-01-16'),
    c AS (SELECT treated_id, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(u) AS uu, var_pop(v) AS vv,
                 covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy FROM rows GROUP BY 1),
    w AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS wu, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS wv FROM c)""") + """
    SELECT treated_id, id AS station_id, round(CASE WHEN id = (SELECT id FROM a) THEN wu ELSE wv END + 3e-9, 6) AS weight,
           round(my - wu * mu - wv * mv + 3e-9, 6) AS intercept
    FROM w, (SELECT id FROM a UNION ALL SELECT id FROM b) d""")
def m3_two(spark, sf_dir):
    m = p_type(spark, sf_dir)
    pool = [r.station_id for r in m.select("station_id").distinct().orderBy("station_id").limit(2).collect()]
    units = panels.assign_all(m, EVENT_START, EVENT_WINDOW).filter(~F.col("treated_id").isin(pool))
    sets = spark.createDataFrame([("all", d) for d in pool], ["donor_set", "station_id"])
    fit = synth.fit_scm(panels.daily_panel(m, units, sets), ["ols"], synth.DAILY)
    return rounded(fit.select("treated_id", "station_id", "weight", "intercept"))


@query("m3_fit_ols_aggregate", with_sql("p_segment", more="""
    d AS (SELECT min(station_id) AS id FROM p_segment),
    rows AS (SELECT t.station_id AS treated_id, s.station_id, s.value AS x, t.value AS y FROM p_segment t
             JOIN p_segment s ON t.date = s.date JOIN d ON s.station_id = d.id AND t.station_id <> d.id
             WHERE t.date < DATE '1999-01-01')""") + """
    SELECT treated_id, station_id, 'ols' AS method, round(regr_slope(y, x) + 3e-9, 6) AS weight,
           round(regr_intercept(y, x) + 3e-6, 3) AS intercept FROM rows GROUP BY 1, 2""")
def m3_sql(spark, sf_dir):
    m = p_segment(spark, sf_dir)
    donor = first_id(m)
    units = panels.assign_all(m, START, WINDOW).filter(F.col("treated_id") != donor)
    sets = spark.createDataFrame([("all", donor)], ["donor_set", "station_id"])
    return rounded(synth.fit_ols_sql(panels.daily_panel(m, units, sets)), 6, intercept=3)


@query("m4_fit_ridge", _tuned_sql(
    "ridge", "SELECT pow(10, -3 + i * 6 / 39) AS a, 0.0::DOUBLE AS r, i AS apos, 0 AS rpos FROM range(40) t(i)",
    "sxy / (sxx + a)", _R2, "score DESC, apos"))
def m4(spark, sf_dir):
    return _fit_columns(synth.fit_scm(one_donor_events(spark, sf_dir), ["ridge"], synth.DAILY))


@query("m5_fit_lasso", _tuned_sql(
    "lasso", "SELECT pow(10, -3 + i * 4 / 39) AS a, 1.0::DOUBLE AS r, i AS apos, 0 AS rpos FROM range(40) t(i)",
    _SOFT, _MSE, "round(score, 9), rpos, a DESC"))
def m5(spark, sf_dir):
    return _fit_columns(synth.fit_scm(one_donor_events(spark, sf_dir), ["lasso"], synth.DAILY))


@query("m6_fit_elasticnet", _tuned_sql(
    "elasticnet", """SELECT pow(10, -3 + i * 4 / 39) AS a, r::DOUBLE AS r, i AS apos, rpos
    FROM range(40) t(i), (VALUES (0.1, 0), (0.5, 1), (0.9, 2)) v(r, rpos)""",
    _SOFT, _MSE, "round(score, 9), rpos, a DESC"))
def m6(spark, sf_dir):
    return _fit_columns(synth.fit_scm(one_donor_events(spark, sf_dir), ["elasticnet"], synth.DAILY))


# --- fits on the full panels (differential tests live in tests/) ---------------


def _rows_only(method: str):
    def run(spark, sf_dir):
        _, units = snation_months(spark, sf_dir)
        pool = pools.pool_panel(p_snation(spark, sf_dir), units)
        return rounded(pools.fit_pool(pool, units, [method], synth.MONTHLY, shared_dir(spark, "fit")), 5)
    return run


for _id, _method in (("m3", "ols"), ("m4", "ridge"), ("m5", "lasso"), ("m6", "elasticnet")):
    query(f"{_id}_fit_{_method}_monthly")(_rows_only(_method))


@query("m3_m6_optimality", SNATION_CELLS + """
    SELECT DISTINCT treated_id, method, station_id, 0.0::DOUBLE AS violation
    FROM cells, (VALUES ('ols'), ('ridge'), ('lasso'), ('elasticnet')) v(method)""")
def optimality(spark, sf_dir):
    """How far the fits with all donors are from their optimality conditions, from the panel's rows.

    With e the residual, x a donor and w its weight: x'e - ridge part of the penalty is 0, or within the
    absolute-value part where w is 0; relative to |x| |y|.
    """
    panel, units = snation_months(spark, sf_dir)
    weights = pools.fit_pool(pools.pool_panel(p_snation(spark, sf_dir), units), units, synth.METHODS, synth.MONTHLY, shared_dir(spark, "fit"))
    fit = synth.predict_scm(panel, weights).select("treated_id", "method", "date", "y_hat")
    cells = panels.long_panel(panel).filter("is_pre").join(fit, ["treated_id", "date"])
    x, y = F.col("x"), F.col("y")
    slopes = cells.groupBy("treated_id", "method", "station_id").agg(
        F.sum(x * (y - F.col("y_hat"))).alias("g"), F.sqrt(F.sum(x * x) * F.sum(y * y)).alias("scale"), F.count(x).alias("n"))
    met = slopes.join(weights, ["treated_id", "method", "station_id"])
    per_row = F.when(F.col("method") == "ridge", 1).otherwise(F.col("n"))
    part = F.when(F.col("method").isin("ols", "ridge"), 0.0).otherwise(F.col("l1_ratio")) * F.col("alpha") * per_row
    slope = F.col("g") - (F.col("alpha") * per_row - part) * F.col("weight")
    violation = F.when(F.col("weight") != 0, F.abs(slope - part * F.signum("weight"))).otherwise(F.greatest(F.lit(0.0), F.abs(slope) - part))
    return rounded(met.select("treated_id", "method", "station_id", F.round(violation / F.col("scale"), 7).alias("violation")).select(
        "treated_id", "method", "station_id", F.abs("violation").alias("violation")), 6)


@query("m4_cv_choice")
def cv_choice(spark, sf_dir):
    panel, _ = segment_days(spark, sf_dir)
    moments = synth.fold_moments(panel)
    return rounded(synth.choose(synth.cv_scores(moments, ("ridge", "lasso", "elasticnet"), synth.DAILY)), 4)


# --- prediction and effects on fixed weights ----------------------------------

_FIT_SQL = SNATION_CELLS.rstrip() + """,
    w AS (SELECT treated_id, station_id, method,
                 CASE WHEN method = 'flat' THEN 1.0 / count(*) OVER (PARTITION BY treated_id, method)
                      ELSE (CAST(station_id AS DOUBLE) + 1) / 300 END AS weight
          FROM (SELECT DISTINCT treated_id, station_id FROM cells), (VALUES ('flat'), ('leaNing')) v(method)),
    fit AS (SELECT treated_id, method, date, any_value(y) AS y, sum(weight * x) AS y_hat
            FROM cells JOIN w USING (treated_id, station_id) GROUP BY 1, 2, 3)
    """


def fixed_weights(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(panel, assignments, weights)`` with an equal and an id-dependent weighting."""
    panel, units = snation_months(spark, sf_dir)
    panel = stored(panel, shared_dir(spark, "panel"))
    pairs = panels.long_panel(panel).select("treated_id", "station_id").distinct()
    n = pairs.groupBy("treated_id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("flat"))
    both = pairs.join(n, "treated_id").withColumn("leaNing", (F.col("station_id").cast("double") + 1) / 300)
    return panel, units, both.unpivot(["treated_id", "station_id"], ["flat", "leaNing"], "method", "weight")


def fixed_fit(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    panel, units, weights = fixed_weights(spark, sf_dir)
    return synth.predict_scm(panel, weights), units


@query("m7_predict_scm", _FIT_SQL + """
    SELECT treated_id, method, date, round(y + 3e-6, 3) AS y, round(y_hat + 3e-6, 3) AS y_hat FROM fit""")
def m7(spark, sf_dir):
    return rounded(fixed_fit(spark, sf_dir)[0], 3)


@query("m14_att_series", _FIT_SQL + """
    SELECT treated_id, method, date, round(y - y_hat + 3e-6, 3) AS att FROM fit""")
def m14(spark, sf_dir):
    return rounded(effects.att_series(fixed_fit(spark, sf_dir)[0]).drop("y", "y_hat"), 3)


@query("a15_att_summary", _FIT_SQL + """
    SELECT treated_id, upper(method[1]) || lower(method[2:]) AS method,
           round(avg(y - y_hat) FILTER (date < DATE '1999-01-01') + 3e-6, 3) AS att_pre,
           round(avg(y - y_hat) FILTER (date >= DATE '1999-01-01') + 3e-6, 3) AS att_post,
           round(avg(y - y_hat) FILTER (date >= DATE '1999-01-01' AND NOT date BETWEEN DATE '2000-03-01' AND DATE '2000-06-30') + 3e-6, 3) AS att_post_ex
    FROM fit GROUP BY treated_id, fit.method""")
def a15(spark, sf_dir):
    fit, units = fixed_fit(spark, sf_dir)
    return rounded(effects.att_summary(effects.with_periods(fit, units)), 3)


@query("a19_rmse", _FIT_SQL + """
    SELECT treated_id, method, round(sqrt(avg((y - y_hat) ** 2) FILTER (date < DATE '1999-01-01')) + 3e-6, 3) AS rmse_pre,
           round(sqrt(avg((y - y_hat) ** 2) FILTER (date >= DATE '1999-01-01')) + 3e-6, 3) AS rmse_post
    FROM fit GROUP BY 1, 2""")
def a19(spark, sf_dir):
    return rounded(effects.rmse(fixed_fit(spark, sf_dir)[0], START), 3)


@query("a20_r2", _FIT_SQL + """
    , m AS (SELECT treated_id, method, avg(y) AS my FROM fit WHERE date < DATE '1999-01-01' GROUP BY 1, 2)
    SELECT treated_id, method, round(1 - sum((y - y_hat) ** 2) / sum((y - my) ** 2) + 3e-9, 6) AS r2_pre
    FROM fit JOIN m USING (treated_id, method) WHERE date < DATE '1999-01-01' GROUP BY 1, 2""")
def a20(spark, sf_dir):
    return rounded(effects.r2(fixed_fit(spark, sf_dir)[0], START))


@query("a21_weight_ranking", _FIT_SQL + """
    SELECT treated_id, station_id, round(coalesce(sum(weight) FILTER (method = 'flat'), 0) + 3e-9, 6) AS flat,
           round(coalesce(sum(weight) FILTER (method = 'leaNing' AND weight > 0.021), 0) + 3e-9, 6) AS "leaNing",
           round((coalesce(sum(abs(weight)) FILTER (method = 'flat'), 0)
              + coalesce(sum(abs(weight)) FILTER (method = 'leaNing' AND weight > 0.021), 0)) / 2 + 3e-9, 6) AS mean_abs
    FROM w GROUP BY 1, 2""")
def a21(spark, sf_dir):
    weights = fixed_weights(spark, sf_dir)[2].filter("method = 'flat' OR weight > 0.021")
    return rounded(effects.weight_ranking(weights, ["flat", "leaNing"]))


_DESCRIBED_NAMES = """(SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS station_id, n_name AS station_name, o_orderpriority AS station_influence
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query("j6_weights_table", _FIT_SQL + f"""
    SELECT treated_id, method, station_id, station_name, station_influence, round(weight + 3e-9, 6) AS weight
    FROM w LEFT JOIN {_DESCRIBED_NAMES} USING (station_id)""")
def j6(spark, sf_dir):
    m = described(spark, sf_dir).select("station_id", "station_name", "station_influence")
    return rounded(effects.weights_table(fixed_weights(spark, sf_dir)[2], m))


@query("j6_weights_table_one_name", _FIT_SQL + f"""
    SELECT treated_id, method, station_id, station_name, station_influence, round(weight + 3e-9, 6) AS weight
    FROM w LEFT JOIN (SELECT station_id, station_name, min(station_influence) AS station_influence FROM {_DESCRIBED_NAMES} GROUP BY 1, 2)
    USING (station_id)""")
def j6_one(spark, sf_dir):
    m = described(spark, sf_dir).select("station_id", "station_name", "station_influence")
    return rounded(effects.weights_table(fixed_weights(spark, sf_dir)[2], m, one_name=True))


# --- trees -------------------------------------------------------------------


def _daily_design(spark, sf_dir):
    m = p_segment(spark, sf_dir)
    return panels.design_daily(panels.daily_panel(m, panels.assign_all(m, START, WINDOW)))


@query("m9_fit_forest")
def m9(spark, sf_dir):
    grown = trees.grow_all(_daily_design(spark, sf_dir), {"rf": trees.daily_models()["rf"]}, store=shared_dir(spark, "trees"), keep_trees=False)
    return rounded(grown.predictions, 3)


@query("m10_fit_boosted")
def m10(spark, sf_dir):
    grown = trees.grow_all(_daily_design(spark, sf_dir), {"gbt": trees.daily_models()["gbt"]}, store=shared_dir(spark, "trees"), keep_trees=False)
    return rounded(grown.predictions, 3)


@query("m10_trees_as_table")
def m10_table(spark, sf_dir):
    """The boosted trees of every station as a table, and predictions from that table."""
    design = _daily_design(spark, sf_dir)
    grown = trees.grow_all(design, {"gbt": trees.daily_models()["gbt"]}, store=shared_dir(spark, "trees"))
    return rounded(trees.predict_trees(design, grown.trees), 3)


def _monthly_design(spark, sf_dir):
    m = p_snation(spark, sf_dir)
    return panels.design_monthly(m, panels.assign_all(m, START, WINDOW))


@query("m11_fit_monthly_trees")
def m11(spark, sf_dir):
    grown = trees.grow_all(_monthly_design(spark, sf_dir), trees.monthly_models(), min_pre=10, store=shared_dir(spark, "trees"), keep_trees=False)
    return rounded(grown.predictions, 3)


@query("m12_time_series_cv")
def m12(spark, sf_dir):
    design = panels.expanding_splits(_monthly_design(spark, sf_dir))
    return rounded(trees.time_series_cv(design, None, trees.monthly_models(), store=shared_dir(spark, "cv")), 3)


@query("m13_own_estimator")
def m13(spark, sf_dir):
    design = _daily_design(spark, sf_dir)
    ids = [r.treated_id for r in design.select("treated_id").distinct().orderBy("treated_id").collect()]  # the market segments
    return rounded(trees.fit_trees(design, ids, {"tree": DecisionTreeRegressor(maxDepth=4)}, store=shared_dir(spark, "trees"))[0], 3)


# Estimators whose fits SQL can repeat: the mean (a tree without a split), one split, a line.


MEAN_TREE = trees.Forest(1, max_depth=0, bootstrap=False)
ONE_SPLIT = {"rf": trees.Forest(1, max_depth=1, bootstrap=False), "gbt": trees.Boosting(1, 1.0, max_leaves=2, min_leaf=1)}


def type_days(spark, sf_dir, one_donor: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Daily event panel with its assignments and treated ids; with one donor, the first type, or all of them."""
    m = p_type(spark, sf_dir)
    units = panels.assign_all(m, EVENT_START, EVENT_WINDOW)
    sets = None
    if one_donor:
        donor = first_id(m)
        units = units.filter(F.col("treated_id") != donor)
        sets = spark.createDataFrame([("all", donor)], ["donor_set", "station_id"])
    ids = [r.treated_id for r in units.select("treated_id").orderBy("treated_id").collect()]  # the event types
    return panels.daily_panel(m, units, sets), units, ids


_TYPE_ROWS = with_sql("p_type", more="""
    donor AS (SELECT min(station_id) AS id FROM p_type),
    rows AS (SELECT t.station_id AS treated_id, t.date, d.value AS x, t.value AS y, t.date < DATE '2024-01-16' AS pre
             FROM p_type t JOIN p_type d ON t.date = d.date JOIN donor ON d.station_id = donor.id AND t.station_id <> donor.id)""")


_ONE_SPLIT_SQL = _TYPE_ROWS + """,
    cuts AS (SELECT DISTINCT treated_id, (x + lead(x) OVER (PARTITION BY treated_id ORDER BY x)) / 2 AS c FROM rows WHERE pre),
    sides AS (SELECT r.treated_id, c, avg(y) FILTER (x <= c) AS lo, avg(y) FILTER (x > c) AS hi,
                     coalesce(var_pop(y) FILTER (x <= c), 0) * count(*) FILTER (x <= c)
                       + coalesce(var_pop(y) FILTER (x > c), 0) * count(*) FILTER (x > c) AS loss
              FROM rows r JOIN cuts USING (treated_id) WHERE pre AND c IS NOT NULL GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY treated_id ORDER BY loss) AS rn FROM sides)"""


@query("m9_m10_one_split", _ONE_SPLIT_SQL + """
    SELECT treated_id, method, date, round(y + 3e-7, 4) AS y, round(CASE WHEN x <= c THEN lo ELSE hi END + 3e-7, 4) AS y_hat
    FROM rows JOIN best USING (treated_id), (VALUES ('rf'), ('gbt')) v(method) WHERE rn = 1""")
def one_split(spark, sf_dir):
    """A forest of one unsampled tree and one boosting round, both with one split on one donor, for every unit."""
    return rounded(trees.grow_all(type_days(spark, sf_dir, True)[0], ONE_SPLIT, min_pre=10).predictions, 4)


@query("m9_m10_one_split_tables", _ONE_SPLIT_SQL + """,
    mean AS (SELECT treated_id, avg(y) AS m FROM rows WHERE pre GROUP BY 1),
    d AS (SELECT id FROM donor)
    SELECT treated_id, method, tree, node, CASE WHEN node = 0 AND inner_node THEN id END AS feature,
           round(CASE WHEN node = 0 AND inner_node THEN c END + 3e-7, 4) AS cut, round(w * CASE node WHEN 1 THEN lo - shift WHEN 2 THEN hi - shift ELSE m - shift END + 3e-7, 4) AS value
    FROM (SELECT treated_id, method, tree, unnest(nodes) AS node, len(nodes) > 1 AS inner_node, 1.0 AS w, CASE WHEN tree = 1 THEN m ELSE 0 END AS shift, lo, hi, c, m
          FROM best JOIN mean USING (treated_id), (VALUES ('rf', 0, [0, 1, 2]), ('gbt', 0, [0]), ('gbt', 1, [0, 1, 2])) v(method, tree, nodes) WHERE rn = 1), d""")
def one_split_tables(spark, sf_dir):
    """The same trees as a table; boosting starts with the mean as its tree 0, and its root then has what is left over on average: nothing."""
    grown = trees.grow_all(type_days(spark, sf_dir, True)[0], ONE_SPLIT, min_pre=10)
    zero = F.when(F.abs("value") < 1e-6, 0.0).otherwise(F.col("value"))
    return rounded(grown.trees.select("treated_id", "method", "tree", "node", "feature", "cut", zero.alias("value")), 4)


@query("m9_m10_table_predictions", _ONE_SPLIT_SQL + """
    SELECT treated_id, method, date, round(y + 3e-7, 4) AS y, round(CASE WHEN x <= c THEN lo ELSE hi END + 3e-7, 4) AS y_hat
    FROM rows JOIN best USING (treated_id), (VALUES ('rf'), ('gbt')) v(method) WHERE rn = 1""")
def table_predictions(spark, sf_dir):
    """Predictions from the table of trees equal those of the fit."""
    design = type_days(spark, sf_dir, True)[0]
    return rounded(trees.predict_trees(design, trees.grow_all(design, ONE_SPLIT, min_pre=10).trees), 4)


@query("m11_monthly_mean_tree", with_sql("p_snation", more=monthly_sql("p_snation")) + """
    SELECT station_id AS treated_id, 'rf' AS method, date, round(value + 3e-6, 3) AS y,
           round(avg(value) FILTER (date < DATE '1999-01-01') OVER (PARTITION BY station_id) + 3e-6, 3) AS y_hat
    FROM monthly WHERE value IS NOT NULL""")
def m11_mean(spark, sf_dir):
    return rounded(trees.grow_all(_monthly_design(spark, sf_dir), {"rf": MEAN_TREE}, min_pre=10).predictions, 3)


@query("m12_mean_tree_errors", TYPE_CELLS + """
    , pre AS (SELECT treated_id, date, y, row_number() OVER (PARTITION BY treated_id ORDER BY date) - 1 AS pos,
                     count(*) OVER (PARTITION BY treated_id) AS n
              FROM (SELECT DISTINCT treated_id, date, y FROM cells WHERE is_pre)),
    tested AS (SELECT *, CAST(CASE WHEN pos >= n - 5 * (n // 6) THEN (pos - (n - 5 * (n // 6))) // (n // 6) END AS INTEGER) AS split FROM pre),
    means AS (SELECT s.treated_id, s.split, avg(p.y) AS y_hat FROM (SELECT DISTINCT treated_id, split FROM tested WHERE split IS NOT NULL) s
              JOIN tested p ON p.treated_id = s.treated_id AND coalesce(p.split, -1) < s.split GROUP BY 1, 2),
    errors AS (SELECT treated_id, split, sqrt(avg((y - y_hat) ** 2)) AS rmse FROM tested JOIN means USING (treated_id, split) GROUP BY 1, 2)
    SELECT treated_id, method, split, round(rmse + 3e-9, 6) AS rmse, round(avg(rmse) OVER (PARTITION BY treated_id) + 3e-9, 6) AS mean_rmse
    FROM errors, (VALUES ('rf'), ('gb')) v(method)""")
def m12_mean(spark, sf_dir):
    models = {"rf": MEAN_TREE, "gb": trees.Boosting(0)}
    return rounded(trees.time_series_cv(panels.expanding_splits(type_days(spark, sf_dir, False)[0]), None, models))


@query("m13_own_estimator_line", _TYPE_ROWS + """,
    line AS (SELECT treated_id, regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM rows WHERE pre GROUP BY 1)
    SELECT treated_id, 'line' AS method, date, round(y + 3e-6, 3) AS y, round(b + w * x + 3e-6, 3) AS y_hat
    FROM rows JOIN line USING (treated_id)""")
def m13_line(spark, sf_dir):
    panel, _, ids = type_days(spark, sf_dir, True)
    return rounded(trees.fit_trees(panel, ids, {"line": LinearRegression(solver="normal")}, min_pre=10)[0], 3)


@query("m15_tree_effects", TYPE_CELLS + """,
    u AS (SELECT DISTINCT treated_id, date, y, is_pre FROM cells),
    f AS (SELECT *, avg(y) FILTER (is_pre) OVER (PARTITION BY treated_id) AS y_hat FROM u)
    SELECT treated_id, method, round(abs(round(avg(y - y_hat) FILTER (is_pre), 4)), 4) AS att_pre,
           round(avg(y - y_hat) FILTER (NOT is_pre) + 3e-7, 4) AS att_post,
           round(avg(y - y_hat) FILTER (NOT is_pre AND NOT date BETWEEN DATE '2024-01-20' AND DATE '2024-01-22') + 3e-7, 4) AS att_post_ex,
           round(abs(round(1 - sum((y - y_hat) ** 2) FILTER (is_pre) / (var_pop(y) FILTER (is_pre) * count(*) FILTER (is_pre)), 4)), 4) AS r2_pre,
           round(sqrt(avg((y - y_hat) ** 2) FILTER (is_pre)) + 3e-7, 4) AS rmse_pre,
           round(sqrt(avg((y - y_hat) ** 2) FILTER (NOT is_pre)) + 3e-7, 4) AS rmse_post
    FROM f, (VALUES ('Forest'), ('Tree')) v(method) GROUP BY 1, 2""")
def tree_effects(spark, sf_dir):
    """Fit, predict, effects and errors of tree models, for all event types and donors."""
    panel, units, ids = type_days(spark, sf_dir, False)
    done = evaluate_trees(panel, units, ids, {"forest": MEAN_TREE, "tree": trees.Boosting(0)}, min_pre=10)
    zero = {c: F.abs(F.round(c, 4)) for c in ("att_pre", "r2_pre")}
    return done.withColumns(zero | {c: F.round(F.col(c) + 3e-7, 4) for c in ("att_post", "att_post_ex", "rmse_pre", "rmse_post")})


# --- everything at once --------------------------------------------------------


@query("m15_evaluate")
def m15(spark, sf_dir):
    """All supplier nations, four methods, monthly."""
    store = shared_dir(spark, "evaluate")
    m = stored(p_snation(spark, sf_dir), f"{store}/daily")
    done = evaluate(m, panels.assign_all(m, START, WINDOW), store=store)
    return rounded(done.effects, 2)


@query("m15_evaluate_daily")
def m15_daily(spark, sf_dir):
    """All order nations on gap-filled days: imputation, panel, four fits, effects."""
    store = shared_dir(spark, "evaluate")
    filled = stored(interpolate_time(p_onation(spark, sf_dir), 1.0)[0], f"{store}/daily")
    units = panels.assign_all(filled, START, WINDOW)
    done = evaluate(filled, units, grain="day", store=store)
    return rounded(done.effects, 2)


_OLS_ONE = with_sql("p_type", more="""
    d AS (SELECT min(station_id) AS id FROM p_type),
    rows AS (SELECT t.station_id AS treated_id, t.date, s.value AS x, t.value AS y, t.date < DATE '2024-01-16' AS pre
             FROM p_type t JOIN p_type s ON t.date = s.date JOIN d ON s.station_id = d.id AND t.station_id <> d.id),
    line AS (SELECT treated_id, regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM rows WHERE pre GROUP BY 1)""")


@query("m15_evaluate_one_donor", _OLS_ONE + """
    SELECT treated_id, 'Ols' AS method, round(avg(y - w * x - b) FILTER (pre) + 3e-9, 6) AS att_pre,
           round(avg(y - w * x - b) FILTER (NOT pre) + 3e-9, 6) AS att_post,
           round(avg(y - w * x - b) FILTER (NOT pre AND NOT date BETWEEN DATE '2024-01-20' AND DATE '2024-01-22') + 3e-9, 6) AS att_post_ex
    FROM rows JOIN line USING (treated_id) GROUP BY 1""")
def m15_one(spark, sf_dir):
    m = p_type(spark, sf_dir)
    donor = first_id(m)
    units = panels.assign_all(m, EVENT_START, EVENT_WINDOW).filter(F.col("treated_id") != donor)
    sets = spark.createDataFrame([("all", donor)], ["donor_set", "station_id"])
    return rounded(evaluate(m, units, sets, grain="day", methods=["ols"]).effects)
