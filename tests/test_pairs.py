"""Correlations from sums by blocks equal pandas, whatever the blocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelcf.operators import describe, pairs


def panel(spark, wide):
    rows = [(c, d.date(), None if pd.isna(v) else float(v)) for c in wide for d, v in wide[c].items()]
    return spark.createDataFrame(rows, "station_id string, date date, value double")


def wide_rows(seed, n=200, width=9):
    rng = np.random.default_rng(seed)
    wide = pd.DataFrame(rng.normal(0, 1, (n, width)).cumsum(0) + 1e6, index=pd.date_range("1969-11-01", periods=n), columns=[f"S{j}" for j in range(width)])
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["S7"] = 0.1  # constant
    wide.loc[wide["S0"].notna(), "S8"] = 5.3  # constant on the days of S0 only
    return wide


@pytest.mark.parametrize("block, chunk", [(512, 512), (2, 16), (3, 7)])
def test_all_pairs_equal_pandas(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "CHUNK", chunk)
    wide = wide_rows(block)
    start = wide.index[150].date()
    got = {(r.treated_id, r.station_id): (r["corr"], r.n_days) for r in describe.pre_correlations(panel(spark, wide), list(wide), start).collect()}
    pre = wide.iloc[:150]
    want = {}
    for a in wide:
        for b in wide:
            both = pre[[a, b]].dropna() if a != b else pre[:0]
            if len(both) > 1 and both[a].nunique() > 1 and both[b].nunique() > 1:
                want[a, b] = np.corrcoef(both[a], both[b])[0, 1], len(both)
    assert got.keys() == want.keys() and ("S0", "S8") not in got and ("S1", "S8") in got
    for k in want:
        assert got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-9)


def test_few_treated_stations_give_the_same(spark, monkeypatch):
    m = panel(spark, wide_rows(1))
    some = {(r.treated_id, r.station_id): (round(r["corr"], 9), r.n_days) for r in describe.pre_correlations(m, ["S1", "S3"], dt.date(1970, 3, 1)).collect()}
    monkeypatch.setattr(describe, "FEW_TREATED", 0)
    again = describe.pre_correlations(m, ["S1", "S3"], dt.date(1970, 3, 1))
    assert {(r.treated_id, r.station_id): (round(r["corr"], 9), r.n_days) for r in again.collect()} == some


def test_no_join_on_days_for_many(spark):
    m = panel(spark, wide_rows(1))
    found = describe.pre_correlations(m, [f"S{k}" for k in range(6)], dt.date(1970, 3, 1))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "date" in line for line in plan.splitlines())
