"""Nothing is lost without an error: broken input, long names, unfinished solves, absent stations, empty periods."""

import datetime as dt
import json

import numpy as np
import pytest

from panelcf.operators import describe, effects, spatial, synth
from panelcf.sources import features, tables

COLLECTION = {"type": "FeatureCollection", "features": [
    {"properties": {"a": str(i)}, "publisher": {"zfe_id": "Z"}, "geometry": None} for i in range(5)]}


def test_long_method_names_keep_all_characters(spark):
    name = "x" + "AB" * 749 + "q"
    row = spark.createDataFrame([("u", name)], "u string, method string").select(effects.capitalised("method").alias("m")).first()
    assert row.m == "X" + name[1:].lower() and len(row.m) == 1500


def test_truncated_collection_and_broken_line_are_errors(spark, tmp_path):
    text = json.dumps(COLLECTION)
    (tmp_path / "whole.json").write_text(text)
    (tmp_path / "cut.json").write_text(text[: len(text) // 2])
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(f) for f in COLLECTION["features"]) + '\n{"properties": {"a": ')
    assert features.read_features(spark, str(tmp_path / "whole.json")).count() == 5
    with pytest.raises(Exception):
        features.read_features(spark, str(tmp_path / "cut.json")).collect()
    with pytest.raises(Exception):
        features.read_features(spark, str(tmp_path / "lines.json"), lines=True).collect()
    with pytest.raises(Exception):
        features.parse_features(spark.createDataFrame([(text[:-20],)], "j string"), "j").collect()


def test_delimited_text(spark, tmp_path):
    (tmp_path / "breaks.csv").write_text('a;b\n1;"two\nlines"\n2;x\n')
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "breaks.csv"), ";").collect()] == [("1", "two\nlines"), ("2", "x")]
    for name, text in (("open", 'a;b\n1;"two\n2;x\n'), ("short", "a;b\n1\n2;x\n"), ("long", "a;b\n1;2;3\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            tables.read_table(spark, str(tmp_path / name), ";").collect()
        with pytest.raises(Exception):
            tables.read_table(spark, str(tmp_path / name), ";").select("a").collect()


def _zone(geometry):
    return [({"id": "1"}, {"zfe_id": "Z"}, json.dumps(geometry))]


def test_collections_of_geometries_are_unpacked_and_others_refused(spark):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}
    two = {"type": "MultiPolygon", "coordinates": [[[[10, 0], [14, 0], [14, 4], [10, 4], [10, 0]]]]}
    schema = "properties map<string,string>, publisher map<string,string>, geometry string"
    stations = spark.createDataFrame([("in", 2.0, 2.0), ("also", 12.0, 2.0), ("out", 7.0, 2.0)], "station_id string, lon double, lat double")
    zone = spark.createDataFrame(_zone({"type": "GeometryCollection", "geometries": [square, two]}), schema)
    assert {r.station_id: r.in_zone for r in spatial.flag_in_zone(stations, zone, "Z").collect()} == {"in": True, "also": True, "out": False}
    line = spark.createDataFrame(_zone({"type": "LineString", "coordinates": [[0, 0], [1, 1]]}), schema)
    with pytest.raises(Exception, match="not a polygon"):
        spatial.flag_in_zone(stations, line, "Z").collect()


def test_sparse_solutions_are_optimal_with_more_donors_than_rows():
    rng = np.random.default_rng(0)
    for k in range(1200):
        rows, donors = int(rng.integers(3, 25)), int(rng.integers(2, 45))
        x = rng.normal(0, 1, (rows, donors)) * (10.0 ** rng.uniform(-1, 2) if k % 3 else 1)
        if k % 4 == 0 and donors > 3:
            x[:, 1] = x[:, 0]
            x[:, 2] = x[:, 0] - x[:, 3]
        y = x @ (rng.normal(0, 1, donors) * (rng.random(donors) < 0.3)) + rng.normal(0, 0.3, rows)
        a, q = x.T @ x, x.T @ y
        top = np.abs(q).max()
        w = np.zeros(donors)
        for share in (0.5, 0.1, 0.01, 0.001):  # a path with warm starts, as in validation
            l1 = share * top
            w = synth._solve_sparse(a, q, l1, w, 10_000)
            slope = q - a @ w
            assert np.all(np.abs(slope) <= l1 + 1e-8 * top), (k, share)
            on = w != 0
            assert np.all(np.abs(slope[on] - l1 * np.sign(w[on])) <= 1e-8 * top), (k, share)


def test_unfinished_solutions_are_errors():
    x = np.random.default_rng(1).normal(0, 1, (20, 10))
    with pytest.raises(RuntimeError, match="no optimum"):
        synth._solve_sparse(x.T @ x, x.T @ x[:, 0], 1e-3, np.zeros(10), 1)


def _panel(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    rows = [("A", day(k), float(k)) for k in range(10)] + [("B", day(k), float(k)) for k in range(4)] + [("C", day(2), None)]
    return spark.createDataFrame(rows, "station_id string, date date, value double")


def test_every_station_has_three_periods(spark):
    got = {(r.station_id, r.period): r for r in describe.pre_post_summary(_panel(spark), "2020-01-06", ("2020-01-07", "2020-01-08")).collect()}
    assert len(got) == 9
    assert [got["A", p].n_days for p in ("pre", "post", "post_ex")] == [5, 5, 3]
    assert (got["B", "post"].n_days, got["B", "post"].mean, got["C", "pre"].n_days) == (0, None, 0)


def test_absent_stations_are_errors(spark):
    m = _panel(spark)
    for frame in (describe.daily_levels(m, "X", "2020-01-06"), describe.pre_correlations(m, ["A", "X"], "2020-01-06"),
                  describe.daily_levels(m.filter("value > 1e9"), "A", "2020-01-06")):
        with pytest.raises(Exception, match="not all of the stations"):
            frame.collect()
    alone = describe.donor_contrast(m, "2020-01-06", 1, 1)
    with pytest.raises(Exception, match="not in the contrast table"):
        describe.delta_ranking(alone.filter("station_id = 'A'"), "X").collect()


def test_prediction_aligns_by_id(spark):
    panel = spark.createDataFrame(
        [("T", dt.date(2020, 1, 1), 5.0, [("A", 1.0), ("B", 2.0), ("C", 4.0)])], "treated_id string, date date, y double, donors array<struct<id:string,x:double>>")
    weights = [("T", "full", "C", 3.0), ("T", "full", "A", 1.0), ("T", "full", "B", 2.0), ("T", "some", "B", 2.0), ("T", "some", "X", 9.0)]
    fit = synth.predict_scm(panel, spark.createDataFrame(weights, "treated_id string, method string, station_id string, weight double"))
    assert {r.method: r.y_hat for r in fit.collect()} == {"full": 17.0, "some": 4.0}


def test_shared_dir_without_the_setting(spark):
    from panelcf.session import shared_dir

    class Bare:  # a session of one process without the setting
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default=None: default)

    first, second = shared_dir(Bare, "a"), shared_dir(Bare, "a")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_collection_keeps_texts_and_refuses_other_encodings(spark, tmp_path):
    geometry = '{"type": "Point",\r\n  "coordinates": [1.50, 1e3]}'
    text = '{"features": [\r\n\n{"properties": {"a": 1.50, "b": "é"}, "geometry": ' + geometry + "}, null]}\n"
    for name, data in (("plain", text.encode()), ("marked", b"\xef\xbb\xbf" + text.encode()), ("empty", b"")):
        (tmp_path / f"{name}.json").write_bytes(data)
        rows = features.read_features(spark, str(tmp_path / f"{name}.json")).collect()
        assert [(r["properties"], r["geometry"]) for r in rows] == [({"a": "1.50", "b": "é"}, geometry)] * (name != "empty")
    for name in ("utf-16", "utf-16-le", "utf-32"):
        (tmp_path / f"{name}.json").write_bytes(text.encode(name))
        with pytest.raises(Exception):
            features.read_features(spark, str(tmp_path / f"{name}.json")).collect()


def test_collection_is_read_once_not_once_for_each_geometry(spark, tmp_path):
    point = {"properties": {"a": "x"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}
    path = tmp_path / "many.json"
    path.write_text(json.dumps({"features": [point] * 3000}, indent=1))

    def read():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    before = read()
    assert len(features.read_features(spark, str(path)).collect()) == 3000
    assert path.stat().st_size <= read() - before < 4 * path.stat().st_size
