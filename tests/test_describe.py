"""Descriptive operators: period edges, absent periods, duplicates."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelcf.operators import clean, describe, zones
from panelcf.operators.effects import weight_ranking, weights_table

SCHEMA = "station_id string, date date, value double"


def daily(spark, columns, first=dt.date(2020, 1, 1)):
    rows = [(s, first + dt.timedelta(days=i), v) for s, vs in columns.items() for i, v in enumerate(vs) if v is not ...]
    return spark.createDataFrame(rows, SCHEMA)


def test_summary_matches_pandas_and_closes_the_window(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(40, 10, 60)
    m = daily(spark, {"A": [None if i % 7 == 0 else float(x) for i, x in enumerate(v)]})
    s = pd.Series([np.nan if i % 7 == 0 else x for i, x in enumerate(v)], index=pd.date_range("2020-01-01", periods=60))
    start, low, high = "2020-02-01", "2020-02-10", "2020-02-12"
    parts = {"pre": s[s.index < start], "post": s[s.index >= start]}
    parts["post_ex"] = parts["post"][(parts["post"].index < low) | (parts["post"].index > high)]
    got = {r.period: r for r in describe.pre_post_summary(m, start, (low, high)).collect()}
    for name, p in parts.items():
        p, r = p.dropna(), got[name]
        want = [p.mean(), p.median(), p.std(), p.quantile(0.1), p.quantile(0.9), len(p)]
        assert np.allclose([r["mean"], r["median"], r["std"], r.p10, r.p90, r.n_days], want)


def test_summary_without_window_repeats_post(spark):
    m = daily(spark, {"A": [1.0, 2.0, 3.0, 5.0]})
    got = {r.period: r["mean"] for r in describe.pre_post_summary(m, "2020-01-03").collect()}
    assert got == {"pre": 1.5, "post": 4.0, "post_ex": 4.0}


def test_contrast_drops_stations_absent_in_a_period(spark):
    m = daily(spark, {"A": [1.0] * 10, "B": [1.0] * 5, "C": [1.0] * 5 + [None] * 5})
    assert [r.station_id for r in describe.donor_contrast(m, "2020-01-06", 1, 1).collect()] == ["A"]
    kept = {r.station_id: r.n_post for r in describe.donor_contrast(m, "2020-01-06", 0, 0).collect()}
    assert kept == {"A": 5, "C": 0}


def test_delta_ranking_is_ordered_and_needs_the_treated_station(spark):
    m = daily(spark, {"A": [1.0] * 5 + [0.0] * 5, "B": [1.0] * 5 + [4.0] * 5, "C": [1.0] * 5 + [2.0] * 5})
    contrast = describe.donor_contrast(m, "2020-01-06", 1, 1)
    rows = describe.delta_ranking(contrast, "A").collect()
    assert [(r.station_id, r.delta_post_pre, r.treated_delta) for r in rows] == [("C", 1.0, -1.0), ("B", 3.0, -1.0)]
    with pytest.raises(Exception, match="not in the contrast table"):
        describe.delta_ranking(contrast, "X").collect()


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(2)
    wide = pd.DataFrame(rng.normal(0, 1, (40, 4)), columns=list("ABCD"))
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    wide["D"] = 3.0
    m = daily(spark, {c: [None if pd.isna(x) else float(x) for x in wide[c]] for c in wide})
    got = {r.station_id: r["corr"] for r in describe.pre_correlations(m, "A", "2020-02-01").collect()}
    pre = wide.iloc[:31]
    assert set(got) == {"B", "C"}
    for c in "BC":
        assert got[c] == pytest.approx(pre[c].corr(pre["A"]))


def test_correlations_refuse_duplicates(spark):
    m = daily(spark, {"A": [1.0, 2.0], "B": [2.0, 1.0]}).unionByName(daily(spark, {"A": [5.0]}))
    with pytest.raises(Exception, match="several rows on one date"):
        describe.pre_correlations(m, "A", "2021-01-01").collect()


def test_monthly_mean_lists_empty_months(spark):
    rows = [("A", dt.date(2020, 1, 30), 1.0), ("A", dt.date(2020, 4, 2), 3.0), ("A", dt.date(2020, 4, 3), 5.0)]
    m = spark.createDataFrame(rows, SCHEMA)
    got = describe.monthly_mean(m, min_days=2, with_empty=True).orderBy("date").collect()
    assert [(r.date.month, r.value, r.n_values) for r in got] == [(1, None, 1), (2, None, 0), (3, None, 0), (4, 4.0, 2)]


def test_wide_and_back(spark):
    m = daily(spark, {"A": [1.0, None, 3.0], "B": [4.0, 5.0, 6.0]})
    back = describe.to_long(describe.to_wide(m, ["A", "B"]))
    want = {(r.station_id, r.date, r.value) for r in m.collect() if r.value is not None}
    assert {(r.station_id, r.date, r.value) for r in back.collect()} == want


def test_month_profile_has_twelve_months(spark):
    got = describe.month_profile(daily(spark, {"A": [1.0, 2.0]}), "2020-01-02").orderBy("month").collect()
    assert [r.month for r in got] == list(range(1, 13))
    assert (got[0].mean_pre, got[0].mean_post, got[1].mean_pre) == (1.0, 2.0, None)


def test_station_meta_mode_ties_and_first_position(spark):
    d = [dt.date(2020, 1, i) for i in range(1, 7)]
    rows = [("S", d[0], "b", None, None), ("S", d[1], "a", 2.0, 7.0), ("S", d[2], "a", 3.0, 8.0), ("S", d[3], "b", 4.0, None),
            ("S", d[4], None, 5.0, None), ("S", d[5], None, 6.0, None), ("N", d[0], None, None, None)]
    m = spark.createDataFrame(rows, "station_id string, date date, station_name string, lat double, lon double")
    got = {r.station_id: (r.station_name, r.lat, r.lon) for r in zones.station_meta(m).collect()}
    assert got == {"S": ("a", 2.0, 7.0), "N": (None, None, None)}


def test_find_station_prefers_pattern_then_fallback(spark):
    m = spark.createDataFrame([("2", "Champs Elysees"), ("1", "CHAMPS bas"), ("0", "Elys"), ("9", None)], "station_id string, station_name string")
    assert clean.find_station(m, "champs").first().station_id == "1"
    assert clean.find_station(m, "frene", "elys").first().station_id == "0"
    with pytest.raises(Exception, match="no station name contains"):
        clean.find_station(m, "frene").collect()


def test_complete_dates_per_group(spark):
    m = daily(spark, {"A": [1.0, None, 3.0], "B": [1.0, 2.0, 3.0], "C": [1.0, 2.0, ...]})
    assert sorted({r.date.day for r in clean.complete_dates(m).collect()}) == [1]
    grouped = m.selectExpr("*", "CASE WHEN station_id = 'C' THEN 'y' ELSE 'x' END AS g")
    got = {(r.g, r.date.day) for r in clean.complete_dates(grouped, group="g").collect()}
    assert got == {("x", 1), ("x", 3), ("y", 1), ("y", 2)}


def test_weight_tables(spark):
    w = spark.createDataFrame([("T", "a", "D1", 0.5), ("T", "b", "D1", -0.1), ("T", "a", "D2", 0.2)],
                              "treated_id string, method string, station_id string, weight double")
    ranks = {r.station_id: (r.a, r.b, r.mean_abs) for r in weight_ranking(w, ["a", "b"]).collect()}
    assert ranks == {"D1": (0.5, -0.1, pytest.approx(0.3)), "D2": (0.2, 0.0, 0.1)}
    m = spark.createDataFrame([("D1", "x"), ("D1", "y"), ("D1", "x")], "station_id string, station_name string")
    assert weights_table(w, m).count() == 5
    assert weights_table(w, m, one_name=True).count() == 3
