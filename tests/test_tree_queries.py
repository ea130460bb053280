"""The registered tree queries run the whole presets on every station, and end."""

import pytest

from panelcf.operators import trees
from panelcf.operators.histtrees import Boosting, Forest
from panelcf.registry import ENTRIES, fitting

SF = "/root/testdata/sf0.01"
MONTHLY = {"rf": Forest(300, max_depth=4), "gb": Boosting(300, 0.05, None, 2, 1)}
PRESETS = {
    "m9_fit_forest": ("grow_all", {"rf": Forest(500, min_leaf=10)}),
    "m10_fit_boosted": ("grow_all", {"gbt": Boosting(500, 0.05, 31, min_leaf=20, features=0.8)}),
    "m11_fit_monthly_trees": ("grow_all", MONTHLY),
    "m12_time_series_cv": ("time_series_cv", MONTHLY),
}


@pytest.mark.parametrize("name", PRESETS)
def test_whole_presets_of_all_stations(spark, monkeypatch, name):
    operator, want = PRESETS[name]
    plain, seen = getattr(trees, operator), []

    def watched(design, *args, **more):
        seen.append(next(a for a in args if a is not None))
        return plain(design, *args, **more)

    monkeypatch.setattr(trees, operator, watched)
    out = ENTRIES[name].run(spark, SF).collect()
    panel = (fitting.p_segment if name.startswith(("m9", "m10")) else fitting.p_snation)(spark, SF)
    stations = {r.station_id for r in panel.select("station_id").distinct().collect()}
    assert seen == [want]
    assert len(stations) > 1 and {(r.treated_id, r.method) for r in out} == {(s, m) for s in stations for m in want}


def test_own_estimator_of_all_stations(spark):
    out = ENTRIES["m13_own_estimator"].run(spark, SF).collect()
    assert {r.treated_id for r in out} == {r.station_id for r in fitting.p_segment(spark, SF).select("station_id").distinct().collect()}


def test_table_of_trees_predicts_like_the_fit(spark):
    fit, table = ({(r.treated_id, r.method, r.date): (r.y, r.y_hat) for r in ENTRIES[n].run(spark, SF).collect()} for n in ("m10_fit_boosted", "m10_trees_as_table"))
    assert fit.keys() == table.keys() and len(fit) > 1000
    assert all(abs(a - b) < 2e-3 for k in fit for a, b in zip(fit[k], table[k]))
