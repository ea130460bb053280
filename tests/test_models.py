"""Panels, penalised fits and effects against plain numpy / pandas."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcf.operators import effects, panel as panels, synth
from panelcf.plans.evaluate import evaluate

START = "2020-03-01"


def series(seed=0, days=90, donors=5, level=20.0, holes=0.0):
    rng = np.random.default_rng(seed)
    dates = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(days)]
    x = level + rng.normal(0, 4, (days, donors)).cumsum(axis=0) * 0.3 + rng.normal(0, 2, (days, donors))
    y = x @ rng.dirichlet(np.ones(donors)) + 1.5 + rng.normal(0, 1, days)
    wide = pd.DataFrame(np.column_stack([y, x]), index=dates, columns=["T"] + [f"D{j}" for j in range(donors)])
    if holes:
        wide = wide.mask(rng.random(wide.shape) < holes)
    return wide


def to_panel(spark, wide):
    long = wide.rename_axis("date").reset_index().melt("date", var_name="station_id", value_name="value")
    rows = [(r.station_id, r.date, None if pd.isna(r.value) else float(r.value)) for r in long.itertuples()]
    return spark.createDataFrame(rows, "station_id string, date date, value double")


def split(wide):
    full = wide.dropna()
    pre = np.array([str(d) < START for d in full.index])
    return full, full.drop(columns="T").to_numpy()[pre], full["T"].to_numpy()[pre]


def folds_of(n, k=5):
    sizes = np.full(k, n // k)
    sizes[: n % k] += 1
    ends = sizes.cumsum()
    return [np.arange(e - s, e) for s, e in zip(sizes, ends)]


def centre(x, y, intercept):
    mx, my = (x.mean(0), y.mean()) if intercept else (np.zeros(x.shape[1]), 0.0)
    return x - mx, y - my, mx, my


def brute_sparse(x, y, alpha, ratio, intercept, sweeps=200_000, tol=1e-13):
    """Coordinate descent on the rows until nothing moves."""
    xc, yc, mx, my = centre(x, y, intercept)
    n, p = xc.shape
    w, r = np.zeros(p), yc.copy()
    norm = (xc**2).sum(0)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(p):
            rho = xc[:, j] @ r + norm[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * ratio * n, 0) / (norm[j] + alpha * (1 - ratio) * n)
            if new != w[j]:
                r -= xc[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved < tol:
            break
    return w, my - mx @ w


def brute_ridge(x, y, alpha, intercept):
    xc, yc, mx, my = centre(x, y, intercept)
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, my - mx @ w


def brute_choice(x, y, method, alphas, ratios, intercept):
    best = None
    for ratio in ratios:
        for alpha in (alphas if method == "ridge" else sorted(alphas, reverse=True)):
            scores = []
            for test in folds_of(len(y)):
                train = np.setdiff1d(np.arange(len(y)), test)
                fit = brute_ridge if method == "ridge" else lambda a, b, c, d: brute_sparse(a, b, c, ratio, d)
                w, b = fit(x[train], y[train], alpha, intercept)
                e = y[test] - x[test] @ w - b
                scores.append(-(1 - (e @ e) / ((y[test] - y[test].mean()) ** 2).sum()) if method == "ridge" else (e @ e) / len(e))
            if best is None or np.mean(scores) < best[0]:
                best = (np.mean(scores), alpha, ratio)
    return best[1:]


@pytest.mark.parametrize("intercept", [False, True])
@pytest.mark.parametrize("alpha,ratio", [(0.01, 1.0), (0.5, 1.0), (3.0, 1.0), (0.3, 0.2), (2.0, 0.8), (200.0, 1.0)])
def test_sparse_solver_reaches_the_optimum(intercept, alpha, ratio):
    _, x, y = split(series(seed=3, donors=8))
    xc, yc, *_ = centre(x, y, intercept)
    n = len(y)
    gram = xc.T @ xc + alpha * (1 - ratio) * n * np.eye(8)
    got = synth._solve_sparse(gram, xc.T @ yc, alpha * ratio * n, np.zeros(8), 10_000)
    want, _ = brute_sparse(x, y, alpha, ratio, intercept)
    assert np.allclose(got, want, atol=1e-7)
    warm = synth._solve_sparse(gram, xc.T @ yc, alpha * ratio * n, np.linspace(-1, 1, 8), 10_000)
    assert np.allclose(warm, want, atol=1e-7)


def test_sparse_solver_with_more_donors_than_dates():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (12, 30))
    y = x[:, :3] @ np.array([2.0, -1.0, 0.5]) + rng.normal(0, 0.1, 12)
    w = synth._solve_sparse(x.T @ x, x.T @ y, 0.05 * 12, np.zeros(30), 10_000)
    slope = x.T @ (y - x @ w)
    assert np.all(np.abs(slope) <= 0.05 * 12 + 1e-8)
    assert np.allclose(slope[w != 0], 0.05 * 12 * np.sign(w[w != 0]), atol=1e-8)


SMALL = synth.ScmSettings(
    fit_intercept=True, ridge_alphas=synth.log_space(-2, 3, 7), lasso_alphas=synth.log_space(-2, 1, 6),
    enet_alphas=synth.log_space(-2, 1, 5), l1_ratios=(0.2, 0.8), min_pre=10)


@pytest.mark.parametrize("intercept", [False, True])
def test_fit_equals_row_level_cross_validation(spark, intercept):
    cfg = replace(SMALL, fit_intercept=intercept)
    wide = series(seed=11, holes=0.01)
    m = to_panel(spark, wide)
    panel = panels.daily_panel(m, panels.assign(spark, "T", START))
    got = synth.fit_scm(panel, synth.METHODS, cfg).toPandas()
    _, x, y = split(wide)
    for method in synth.METHODS:
        mine = got[got.method == method].sort_values("station_id")
        assert list(mine.station_id) == [f"D{j}" for j in range(5)]
        if method == "ols":
            xc, yc, mx, my = centre(x, y, intercept)
            w = np.linalg.lstsq(xc, yc, rcond=None)[0]
            b = my - mx @ w
        else:
            alphas = {"ridge": cfg.ridge_alphas, "lasso": cfg.lasso_alphas, "elasticnet": cfg.enet_alphas}[method]
            ratios = {"ridge": (0.0,), "lasso": (1.0,), "elasticnet": cfg.l1_ratios}[method]
            alpha, ratio = brute_choice(x, y, method, alphas, ratios, intercept)
            assert mine.alpha.iloc[0] == pytest.approx(alpha) and mine.l1_ratio.iloc[0] == pytest.approx(ratio)
            w, b = brute_ridge(x, y, alpha, intercept) if method == "ridge" else brute_sparse(x, y, alpha, ratio, intercept)
        assert np.allclose(mine.weight, w, atol=1e-6)
        assert mine.intercept.iloc[0] == pytest.approx(b, abs=1e-6)


def test_collinear_donors_get_the_shortest_solution(spark):
    wide = series(seed=2, donors=3)
    wide["D2"] = wide["D0"]
    panel = panels.daily_panel(to_panel(spark, wide), panels.assign(spark, "T", START))
    got = synth.fit_scm(panel, ["ols"], synth.DAILY).orderBy("station_id").toPandas()
    _, x, y = split(wide)
    want = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    assert np.allclose(got.weight, want, atol=1e-6)


def test_mllib_agrees_under_the_penalty_mapping(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    wide = series(seed=4)
    cfg = replace(SMALL, ridge_alphas=(5.0,), enet_alphas=(0.3,), l1_ratios=(0.5,))
    panel = panels.daily_panel(to_panel(spark, wide), panels.assign(spark, "T", START))
    got = synth.fit_scm(panel, ["ridge", "elasticnet"], cfg).toPandas()
    rows = panel.filter("is_pre").select("y", array_to_vector(F.transform("donors", lambda d: d["x"])).alias("features"))
    _, _, y = split(wide)
    for method, l1, l2 in (("ridge", 0.0, 5.0 / len(y)), ("elasticnet", 0.15, 0.15)):
        reg = l1 + l2 * y.std()
        model = LinearRegression(labelCol="y", regParam=reg, elasticNetParam=l1 / reg, standardization=False,
                                 solver="normal", maxIter=1000, tol=1e-12).fit(rows)
        mine = got[got.method == method].sort_values("station_id")
        assert np.allclose(mine.weight, model.coefficients.toArray(), atol=1e-4)


def test_panel_is_complete_case(spark):
    wide = series(seed=6, holes=0.05)
    got = panels.long_panel(panels.daily_panel(to_panel(spark, wide), panels.assign(spark, "T", START))).toPandas()
    full, *_ = split(wide)
    assert sorted(set(got.date)) == list(full.index)
    back = got.pivot(index="date", columns="station_id", values="x")
    assert np.allclose(back.to_numpy(), full.drop(columns="T").to_numpy())
    assert "T" not in set(got.station_id)


def test_all_null_donor_empties_the_panel(spark):
    wide = series(seed=6)
    wide["D4"] = np.nan
    units = panels.assign(spark, "T", START)
    panel = panels.daily_panel(to_panel(spark, wide), units)
    assert panel.count() == 0
    with pytest.raises(ValueError, match="no complete date"):
        panels.require_fittable(panel, units)


def test_donors_never_seen_together_give_no_dates(spark):
    rows = [("T", d, 1.0) for d in (1, 2, 3, 4)] + [("A", d, 1.0) for d in (1, 2)] + [("B", d, 1.0) for d in (3, 4)]
    m = spark.createDataFrame([(s, dt.date(2020, 1, d), v) for s, d, v in rows], "station_id string, date date, value double")
    assert panels.daily_panel(m, panels.assign(spark, "T", START)).count() == 0
    short = {r.station_id: r.n_dates for r in panels.limiting_donors(m, "day").collect()}
    assert short == {"A": 2, "B": 2}


def test_guards(spark):
    m = to_panel(spark, series(seed=1))
    absent = panels.assign(spark, "X", START)
    with pytest.raises(ValueError, match="'X'"):
        panels.require_fittable(panels.daily_panel(m, absent), absent)
    early = panels.assign(spark, "T", "2020-01-05")
    with pytest.raises(ValueError, match="fewer than 10"):
        panels.require_fittable(panels.daily_panel(m, early), early, 10)
    twice = absent.withColumn("treated_id", F.lit("T")).unionByName(early)
    with pytest.raises(ValueError, match="more than once"):
        panels.require_fittable(panels.daily_panel(m, twice), twice)
    with pytest.raises(ValueError, match="unknown methods"):
        synth.fit_scm(panels.daily_panel(m, early), ["svm"])


def test_unit_weight_returns_the_donor(spark):
    wide = series(seed=8)
    panel = panels.daily_panel(to_panel(spark, wide), panels.assign(spark, "T", START))
    w = spark.createDataFrame([("T", "one", "D2", 1.0)], "treated_id string, method string, station_id string, weight double")
    got = {r.date: r.y_hat for r in synth.predict_scm(panel, w).collect()}
    assert got == pytest.approx(wide["D2"].to_dict())


def test_ridge_without_penalty_is_ols_and_intercept_zeroes_the_pre_effect(spark):
    m = to_panel(spark, series(seed=9))
    cfg = replace(SMALL, ridge_alphas=(1e-9,))
    done = evaluate(m, panels.assign(spark, "T", START), grain="day", methods=["ols", "ridge"], cfg=cfg)
    w = done.weights.toPandas().pivot(index="station_id", columns="method", values="weight")
    assert np.allclose(w["ols"], w["ridge"], atol=1e-6)
    for r in done.effects.collect():
        assert r.att_pre == pytest.approx(0, abs=1e-8)
        assert r.att_post == r.att_post_ex


def test_many_units_equal_one_at_a_time(spark, tmp_path):
    m = to_panel(spark, series(seed=10, donors=4))
    units = panels.assign_all(m, START, ("2020-03-05", "2020-03-10"))
    cfg = replace(SMALL, l1_ratios=(0.5,))
    together = evaluate(m, units, grain="day", cfg=cfg, store=str(tmp_path)).effects.toPandas().set_index(["treated_id", "method"])
    assert len(together) == 20
    alone = evaluate(m, units.filter("treated_id = 'D1'"), grain="day", cfg=cfg).effects.toPandas().set_index(["treated_id", "method"])
    assert np.allclose(alone, together.loc[alone.index], atol=1e-9)


def test_att_summary_window_is_closed_and_names_are_capitalised(spark):
    fit = spark.createDataFrame(
        [("T", "elasticnet", dt.date(2020, m, 1), float(m), 0.0) for m in range(1, 7)] + [("T", "elasticnet", dt.date(2020, 7, 1), None, 0.0)],
        "treated_id string, method string, date date, y double, y_hat double")
    row = effects.att_summary(fit, "2020-03-01", ("2020-04-01", "2020-05-01")).first()
    assert (row.method, row.att_pre, row.att_post, row.att_post_ex) == ("Elasticnet", 1.5, 4.5, 4.5)
    row = effects.att_summary(fit, "2020-03-01", ("2020-05-01", "2020-06-01")).first()
    assert row.att_post_ex == 3.5


def test_r2_and_rmse(spark):
    rng = np.random.default_rng(0)
    y, h = rng.normal(5e4, 10, 40), rng.normal(5e4, 10, 40)
    fit = spark.createDataFrame(
        [("T", "a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(y[i]), float(h[i])) for i in range(40)],
        "treated_id string, method string, date date, y double, y_hat double")
    e = ((y - h) ** 2)[:31]
    assert effects.r2(fit, "2020-02-01").first().r2_pre == pytest.approx(1 - e.sum() / ((y[:31] - y[:31].mean()) ** 2).sum())
    assert effects.rmse(fit, "2020-02-01").first().rmse_pre == pytest.approx(np.sqrt(e.mean()))


def test_trees_track_the_signal_and_guard_short_periods(spark):
    from panelcf.operators import trees

    wide = series(seed=12, days=160)
    m = to_panel(spark, wide)
    design = panels.design_daily(panels.daily_panel(m, panels.assign(spark, "T", "2020-05-01")))
    models = {"rf": trees.daily_models(n_trees=10, max_depth=8)["rf"], "gbt": trees.daily_models(n_rounds=10)["gbt"]}
    fit, fitted = trees.fit_trees(design, "T", models, seed=3)
    assert set(fitted) == {("T", "rf"), ("T", "gbt")}
    assert fit.count() == 2 * len(wide)
    scores = {r.method: r.r2_pre for r in effects.r2(fit, "2020-05-01").collect()}
    assert scores["rf"] > 0.4 and scores["gbt"] > 0.3
    with pytest.raises(ValueError, match="at least 50"):
        trees.fit_trees(panels.design_daily(panels.daily_panel(m, panels.assign(spark, "T", "2020-02-01"))), "T", models)
