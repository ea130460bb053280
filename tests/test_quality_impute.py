"""Calendars, gaps and filling against pandas, plus properties that tie them together."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelcf.operators import describe, impute, quality

SCHEMA = "station_id string, date date, value double, station_name string, lat double"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def random_rows(seed=1, stations=12, days=70):
    """Irregular series: absent rows, null values, null edges, one all-null series, one hot series."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(stations):
        lo, hi = sorted(rng.choice(days, 2, replace=False))
        for n in range(lo, hi + 1):
            if rng.random() < 0.35 and n not in (lo, hi):
                continue
            value = None if rng.random() < 0.25 or s == 3 else float(np.round(rng.normal(30, 9), 3))
            rows.append((f"S{s}", day(n), value, f"name {s}", 45.0 + s))
    rows += [("HOT", day(n), float(n % 17), "hot", 1.0) for n in range(days) if n % 5]
    return rows


@pytest.fixture(scope="module")
def rows():
    return random_rows()


@pytest.fixture(scope="module")
def m(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def frame(rows):
    out = pd.DataFrame(rows, columns=["station_id", "date", "value", "station_name", "lat"])
    out["date"] = pd.to_datetime(out["date"])
    return out


def grid_of(rows):
    for sid, sub in frame(rows).groupby("station_id"):
        sub = sub.sort_values("date").set_index("date")
        yield sid, sub.reindex(pd.date_range(sub.index.min(), sub.index.max(), freq="D"))


def as_dict(df, *keys, value="value"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_complete_calendar(m, rows):
    got = as_dict(quality.complete_calendar(m), "station_id", "date")
    want = {(s, d.date()): v for s, g in grid_of(rows) for d, v in g["value"].items()}
    assert got.keys() == want.keys()
    assert all((v is None) == pd.isna(want[k]) and (v is None or v == want[k]) for k, v in got.items())


def test_missing_summary_matches_grid(m, rows):
    got = {r.station_id: r for r in quality.missing_summary(m).collect()}
    for s, g in grid_of(rows):
        assert got[s].missing_days == g["value"].isna().sum()
        assert got[s].n_days == len(g)
        assert got[s].station_name == g["station_name"].iloc[0]


def test_gaps_sum_to_missing_days(m, rows):
    gaps = quality.gap_intervals(m)
    total = as_dict(gaps.groupBy("station_id").agg(F.sum("gap_length_days").alias("n")), "station_id", value="n")
    for s, g in grid_of(rows):
        assert total.get((s,), 0) == g["value"].isna().sum()
    spans = gaps.collect()
    assert all((r.gap_end - r.gap_start).days + 1 == r.gap_length_days for r in spans)
    by = {}
    for r in sorted(spans, key=lambda r: (r.station_id, r.gap_start)):
        if r.station_id in by:
            assert (r.gap_start - by[r.station_id]).days > 1
        by[r.station_id] = r.gap_end


def test_no_gaps_is_empty_and_typed(spark):
    full = spark.createDataFrame([("A", day(n), 1.0, "a", 0.0) for n in range(5)], SCHEMA)
    gaps = quality.gap_intervals(full)
    assert gaps.collect() == []
    assert dict(gaps.dtypes)["gap_start"] == "date"


def test_interpolate_time_equals_pandas(m, rows):
    got_df, dropped = impute.interpolate_time(m, 1.0)
    assert dropped.count() == 0
    got = as_dict(got_df, "station_id", "date")
    for s, g in grid_of(rows):
        want = g["value"].astype(float).interpolate(method="time", limit_direction="both")
        for d, v in want.items():
            mine = got.pop((s, d.date()))
            assert (mine is None and pd.isna(v)) or mine == pytest.approx(v, abs=1e-9)
    assert not got


def test_interpolate_keeps_meta_and_blanks_position(m, rows):
    filled = impute.interpolate_time(m, 1.0)[0].collect()
    existing = {(r[0], r[1]) for r in rows}
    names = {r[0]: r[3] for r in rows}
    for r in filled:
        assert r.station_name == names[r.station_id]
        assert (r.lat is not None) == ((r.station_id, r.date) in existing)


def test_interpolate_limit_is_strict(spark):
    rows = [("A", day(0), 1.0, "a", 0.0), ("A", day(4), 5.0, "a", 0.0)]  # 3 of 5 missing
    m = spark.createDataFrame(rows, SCHEMA)
    kept, dropped = impute.interpolate_time(m, 0.6)
    assert (kept.count(), dropped.count()) == (5, 0)
    kept, dropped = impute.interpolate_time(m, 0.59)
    assert kept.count() == 0 and [r.station_id for r in dropped.collect()] == ["A"]


def test_observed_values_survive_and_fill_stays_between(m, rows):
    filled = as_dict(impute.interpolate_time(m, 1.0)[0], "station_id", "date")
    for s, d, v, *_ in rows:
        if v is not None:
            assert filled[(s, d)] == v
    for s, g in grid_of(rows):
        known = g["value"].dropna()
        if len(known):
            mine = [filled[(s, d.date())] for d in g.index]
            assert min(mine) >= known.min() - 1e-9 and max(mine) <= known.max() + 1e-9


def test_interpolate_position_equals_pandas(spark, m, rows):
    monthly = frame(rows).groupby(["station_id", "date"])["value"].mean().unstack(0)
    want = monthly.interpolate(limit_direction="both")
    got = as_dict(impute.interpolate_position(m.select("station_id", "date", "value")), "station_id", "date")
    assert len(got) == want.size
    for (s, d), v in got.items():
        w = want.loc[pd.Timestamp(d), s]
        assert (v is None and pd.isna(w)) or v == pytest.approx(w, abs=1e-9)


@pytest.mark.parametrize("window", [1, 6, 7, 30])
def test_rolling_mean_equals_pandas(m, rows, window):
    got = as_dict(describe.rolling_mean(m, window), "station_id", "date", value="smooth")
    for s, sub in frame(rows).groupby("station_id"):
        sub = sub.sort_values("date")
        want = sub["value"].astype(float).rolling(window, center=True, min_periods=1).mean()
        for d, v in zip(sub["date"], want):
            mine = got[(s, d.date())]
            assert (mine is None and pd.isna(v)) or mine == pytest.approx(v, abs=1e-9)


def test_duplicates_are_averaged_or_refused(spark):
    m = spark.createDataFrame([("A", day(0), 1.0, "a", 0.0), ("A", day(0), 3.0, "a", 0.0)], SCHEMA)
    assert quality.unique_days(m).first().value == 2.0
    with pytest.raises(PySparkException, match="several rows on one date"):
        quality.unique_days(m, on_duplicates="error").collect()


def test_keep_stations_counts_against_all_panel_dates(m, rows):
    wide = frame(rows).pivot(index="date", columns="station_id", values="value")
    missing = wide.isna().sum()
    assert as_dict(quality.missing_periods(m), "station_id", value="missing_periods") == {
        (s,): n for s, n in missing.items()}
    kept = {r.station_id for r in quality.keep_stations(m, 30).select("station_id").distinct().collect()}
    assert kept == set(missing[missing <= 30].index)


def test_hot_station_is_reduced_before_it_is_shuffled(spark):
    """A station with many raw rows: the plan aggregates partially below every exchange."""
    raw = spark.range(0, 50_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 97).cast("string")).alias("station_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("date"),
        (F.col("id") % 11).cast("double").alias("value"))
    filled, _ = impute.interpolate_time(raw, 1.0)
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan and "Window" in plan and "Exchange SinglePartition" not in plan
    assert filled.filter("station_id = 'HOT'").count() == 40


def test_trend_index_both_ways(spark):
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(15)]
    m = spark.createDataFrame([("A", d, 1.0) for d in months], "station_id string, date date, value double")
    for contiguous in (False, True):
        out = quality.trend_index(m, contiguous_months=contiguous).orderBy("date").collect()
        assert [r.trend for r in out] == list(range(15))
