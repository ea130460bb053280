"""Fits that share one matrix equal the fits of each unit by itself."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcf.operators import panel as panels
from panelcf.operators import pool, synth
from panelcf.operators.effects import att_summary, with_periods
from panelcf.plans.evaluate import evaluate


def panel_rows(spark, n=120, width=6, seed=1, gaps=True):
    """Correlated daily series; some values missing, a station that is null on a day, one constant series."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 2)).cumsum(0)
    values = base @ rng.normal(size=(2, width)) + rng.normal(size=(n, width)) + 20
    values[:, width - 1] = 7.0
    rows = []
    for k in range(n):
        for j in range(width):
            if gaps and (k * 7 + j * 3) % 29 == 0:
                continue
            rows.append((f"S{j}", dt.date(2020, 1, 1) + dt.timedelta(days=k), None if gaps and (k, j) == (50, 2) else float(values[k, j])))
    return spark.createDataFrame(rows, "station_id string, date date, value double")


def two_starts(spark, m):
    late = panels.assign(spark, ["S1", "S3"], "2020-03-20")
    return panels.assign(spark, ["S0", "S2", "S4"], "2020-03-01", ("2020-03-10", "2020-03-12")).unionByName(late)


def collected(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize("cfg", [synth.DAILY, synth.MONTHLY])
def test_weights_and_predictions_equal_single_fits(spark, monkeypatch, cfg):
    monkeypatch.setattr(pool, "BLOCK", 2)
    m = panel_rows(spark)
    units = two_starts(spark, m)
    single = panels.daily_panel(m, units)
    shared = pool.pool_panel(m, units, "day")
    want_w, got_w = synth.fit_scm(single, cfg=cfg), pool.fit_pool(shared, units, cfg=cfg)
    want, got = (collected(w, "treated_id", "method", "station_id") for w in (want_w, got_w))
    assert got.keys() == want.keys() and len(got) == 5 * 4 * 5
    for k, w in want.items():
        assert (got[k].alpha, got[k].l1_ratio) == (w.alpha, w.l1_ratio), k
        assert got[k].weight == pytest.approx(w.weight, abs=1e-8) and got[k].intercept == pytest.approx(w.intercept, abs=1e-7), k
    want, got = (collected(f, "treated_id", "method", "date") for f in (synth.predict_scm(single, want_w), pool.predict_pool(shared, got_w, units)))
    assert got.keys() == want.keys()
    assert all(got[k].y == want[k].y and got[k].y_hat == pytest.approx(want[k].y_hat, abs=1e-7) for k in want)


def test_units_of_a_start_share_one_matrix(spark):
    """Moments are a row per start and fold, and the panel a row per start and date, however many units there are."""
    m = panel_rows(spark, gaps=False)
    many, one = panels.assign_all(m, "2020-03-01"), panels.assign(spark, "S0", "2020-03-01")
    for units in (many, one):
        shared = pool.pool_panel(m, units, "day")
        assert shared.count() == 120
        assert collected(pool.pool_moments(shared), "start", "fold").keys() == {(dt.date(2020, 3, 1), k) for k in range(5)}
    assert pool.pool_panel(m, two_starts(spark, m), "day").count() == 240


def test_collinear_stations(spark):
    """A station that is a sum of others: the shortest solution, as for a unit by itself."""
    m = panel_rows(spark, gaps=False).filter("station_id != 'S5'")
    twin = m.filter("station_id = 'S1'").withColumn("station_id", F.lit("S9"))
    m = m.unionByName(twin)
    units = panels.assign_all(m, "2020-03-01")
    want = collected(synth.fit_scm(panels.daily_panel(m, units), ["ols", "ridge"], synth.DAILY), "treated_id", "method", "station_id")
    got = collected(pool.fit_pool(pool.pool_panel(m, units, "day"), units, ["ols", "ridge"], synth.DAILY), "treated_id", "method", "station_id")
    assert got.keys() == want.keys()
    assert all(got[k].weight == pytest.approx(want[k].weight, abs=1e-6) for k in want)


def test_evaluation_is_the_same_with_and_without_a_pool(spark):
    m = panel_rows(spark)
    units = panels.assign_all(m, "2020-03-01", ("2020-03-10", "2020-03-12"))
    sets = m.select(F.lit("all").alias("donor_set"), "station_id").distinct()
    shared, single = evaluate(m, units, grain="day"), evaluate(m, units, sets, grain="day")
    want, got = (collected(e.effects, "treated_id", "method") for e in (single, shared))
    assert got.keys() == want.keys() and len(got) == 24
    for k in want:
        assert [getattr(got[k], c) for c in ("att_pre", "att_post", "att_post_ex")] == pytest.approx(
            [getattr(want[k], c) for c in ("att_pre", "att_post", "att_post_ex")], abs=1e-6)
    assert att_summary(with_periods(shared.fit, units)).count() == 24
    assert shared.panel.count() == single.panel.count()


def test_units_that_cannot_be_fitted(spark):
    m = panel_rows(spark)
    with pytest.raises(ValueError, match="'X': no complete date"):
        evaluate(m, panels.assign(spark, ["S0", "X"], "2020-03-01"), grain="day")
    with pytest.raises(ValueError, match="fewer than 10 complete dates"):
        evaluate(m, panels.assign(spark, ["S0"], "2020-01-05"), grain="day")
    with pytest.raises(ValueError, match="more than once"):
        evaluate(m, panels.assign(spark, ["S0"], "2020-03-01").unionByName(panels.assign(spark, ["S0"], "2020-03-01")), grain="day")
    with pytest.raises(ValueError, match="unknown methods"):
        pool.fit_pool(pool.pool_panel(m, panels.assign(spark, "S0", "2020-03-01"), "day"), panels.assign(spark, "S0", "2020-03-01"), ["best"])
