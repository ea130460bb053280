import datetime
import random

import numpy as np
import pytest

from panelcf.operators import panel as panels

MONTHS = [datetime.date(2020 + i // 12, i % 12 + 1, 1) for i in range(30)]
SCHEMA = "station_id string, date date, value double"


def cells(seed):
    """Eight stations; the first four have the same months, the others gaps of their own, one hardly any value."""
    rng = random.Random(seed)
    out = {}
    for k in range(8):
        share = 1.0 if k < 4 else 0.1 if k == 7 else 0.7
        out[f"S{k}"] = {d: rng.uniform(5, 50) for d in MONTHS if rng.random() < share}
    return out


def brute(data, unit, donors):
    months = sorted(data[unit])
    rows = []
    for p, d in enumerate(months):
        found = []
        for donor in sorted(set(donors) - {unit}):
            known = [(i, data[donor][m]) for i, m in enumerate(months) if m in data[donor]]
            if known:
                found.append((donor, float(np.interp(p, *zip(*known)))))
        rows.append((unit, d, data[unit][d], found, p))
    return rows


def check(got, want):
    got = sorted(got, key=lambda r: (r["treated_id"], r["date"]))
    assert [(r["treated_id"], r["date"], r["y"], r["trend"]) for r in got] == [(u, d, y, p) for u, d, y, _, p in want]
    for r, (*_, found, _p) in zip(got, want):
        assert [x["id"] for x in r["donors"]] == [i for i, _ in found]
        assert [x["x"] for x in r["donors"]] == pytest.approx([x for _, x in found], rel=1e-12)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_interpolation_by_unit(spark, seed):
    data = cells(seed)
    m = spark.createDataFrame([(s, d, v) for s, c in data.items() for d, v in c.items()] + [("S5", MONTHS[3].replace(day=2), None)], SCHEMA)
    got = panels.design_monthly(m, panels.assign_all(m, "2021-06-01")).collect()
    check(got, [r for s in sorted(data) for r in brute(data, s, data)])
    assert all(r["is_pre"] == (r["date"] < datetime.date(2021, 6, 1)) for r in got)


def test_donor_sets_and_a_unit_without_donors(spark):
    data = cells(4)
    m = spark.createDataFrame([(s, d, v) for s, c in data.items() for d, v in c.items()], SCHEMA)
    sets = spark.createDataFrame([("a", "S4"), ("a", "S5"), ("a", "S0"), ("b", "S1")], "donor_set string, station_id string")
    units = panels.assign(spark, ["S0", "S6"], "2021-06-01", donor_set="a").unionByName(
        panels.assign(spark, ["S1"], "2021-06-01", donor_set="b"))
    want = [*brute(data, "S0", ["S0", "S4", "S5"]), *brute(data, "S1", ["S1"]), *brute(data, "S6", ["S0", "S4", "S5"])]
    check(panels.design_monthly(m, units, sets).collect(), want)
    none = spark.createDataFrame([], SCHEMA)
    assert panels.design_monthly(none, units, sets).collect() == []


def test_units_with_equal_months_share_their_donors(spark):
    """Filled rows grow with donors and distinct sets of months, not with units."""
    rows = [(f"S{k}", d, float(k + i)) for k in range(20) for i, d in enumerate(MONTHS) if k < 15 or i % 3]
    m = spark.createDataFrame(rows, SCHEMA)
    series = panels._series(m, "month", panels.HOUSE)
    units, classes = panels._calendar_classes(series, panels.assign_all(m, "2021-06-01"), True)
    assert units.count() == 20 and classes.count() == 2
    assert panels._class_donors(series, classes, None).count() == 20 * (30 + 20)
