"""Adding batches to a stored panel: rows, untouched files, repeated runs."""

import datetime as dt
from pathlib import Path

import pytest

from panelcf.sources import tables, upsert

SCHEMA = "station_id string, date date, value double, note string"


def day(text):
    return dt.date.fromisoformat(text) if text else None


def frame(spark, *rows):
    return spark.createDataFrame([(s, day(d), v, n) for s, d, v, n in rows], SCHEMA)


def held(spark, path):
    rows = spark.read.parquet(path).drop("year").select("station_id", "date", "value", "note").collect()
    return sorted(map(tuple, rows), key=repr)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def panel(spark, tmp_path):
    path = str(tmp_path / "panel")
    added = upsert.upsert_panel(spark, path, frame(
        spark, ("A", "2019-01-01", 1.0, "a"), ("A", "2019-01-01", 2.0, "b"), ("B", "2020-05-01", 3.0, None), (None, "2020-05-02", 4.0, "c"),
        ("C", None, 5.0, "d")), order=["value"])
    assert added == {2019: 1, 2020: 2, None: 1}
    return path


def test_stored_rows_win_and_runs_repeat(spark, panel):
    before, old = files(panel), held(spark, panel)
    assert ("A", day("2019-01-01"), 1.0, "a") in old and len(old) == 4
    batch = frame(spark, ("A", "2019-01-01", 9.0, "x"), ("A", "2020-01-01", 9.0, "x"), (None, "2020-05-02", 9.0, "x"), ("C", None, 9.0, "x"),
                  ("D", None, 9.0, "x"), ("A", "2020-01-01", 9.5, "y"))
    assert upsert.upsert_panel(spark, panel, batch, ["value"]) == {2020: 1, None: 1}
    now = held(spark, panel)
    assert now == sorted([*old, ("A", day("2020-01-01"), 9.0, "x"), ("D", None, 9.0, "x")], key=repr)
    after = files(panel)
    assert {k: after[k] for k in before} == before
    assert {Path(p).parent.name for p in set(after) - set(before)} == {"year=2020", "year=__HIVE_DEFAULT_PARTITION__"}
    assert upsert.upsert_panel(spark, panel, batch, ["value"]) == {}
    assert files(panel) == after


def test_only_touched_years_are_read(spark, panel):
    batch = upsert._like(frame(spark, ("A", "2020-01-01", 9.0, "x")), spark.read.parquet(panel)).selectExpr("*", "2020 AS year")
    plan = spark.read.parquet(panel).filter(upsert._near(batch, upsert.HOUSE))._jdf.queryExecution().executedPlan().toString()
    folders, pushed = (plan.split(f"{name}: [")[1] for name in ("PartitionFilters", "PushedFilters"))
    assert "2020" in folders.split("]")[0] and "2019" not in folders.split("]")[0]
    assert "GreaterThanOrEqual(station_id,A)" in pushed  # the rest of a long condition isn't printed


def test_columns(spark, panel):
    short = spark.createDataFrame([("E", "2021-01-01")], "station_id string, date string")
    assert upsert.upsert_panel(spark, panel, short) == {2021: 1}
    assert ("E", day("2021-01-01"), None, None) in held(spark, panel)
    with pytest.raises(ValueError, match="extra"):
        upsert.upsert_panel(spark, panel, short.selectExpr("*", "1 AS extra"))


def test_empty_batches(spark, panel, tmp_path):
    before = files(panel)
    assert upsert.upsert_panel(spark, panel, frame(spark)) == {}
    assert files(panel) == before


def test_equals_the_operator_in_memory(spark, tmp_path):
    path = str(tmp_path / "p")
    batches = [frame(spark, *[(f"S{(7 * i + k) % 5}", f"20{18 + (i + k) % 3}-0{1 + i % 9}-11", float(i), str(k)) for i in range(40)]) for k in range(3)]
    want = None
    for b in batches:
        upsert.upsert_panel(spark, path, b, ["value"])
        want = upsert.upsert_keep_first(want, b, ["station_id", "date"], ["value"])
    assert held(spark, path) == sorted(map(tuple, want.select("station_id", "date", "value", "note").collect()), key=repr)


def test_compaction_keeps_rows_and_other_years(spark, panel):
    for i in range(3):
        upsert.upsert_panel(spark, panel, frame(spark, (f"N{i}", "2020-07-01", 1.0, None), (f"N{i}", "2019-07-01", 1.0, None)))
    rows, before = held(spark, panel), files(panel)
    upsert.compact_years(spark, panel, [2020])
    after = files(panel)
    assert held(spark, panel) == rows
    assert len([p for p in after if "year=2020" in p]) == 1
    assert {p: t for p, t in before.items() if "year=2020" not in p} == {p: t for p, t in after.items() if "year=2020" not in p}


def test_write_panel_still_replaces(spark, panel):
    tables.write_panel(frame(spark, ("Z", "2022-01-01", 1.0, None)), panel)
    assert len(held(spark, panel)) == 1
