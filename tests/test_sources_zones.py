"""Feature collections, delimited files, upsert, and the zone tables on real rows."""

import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException

from panelcf.operators import clean
from panelcf.plans.prepare import prepare
from panelcf.plans.zone_tables import build_zone_tables
from panelcf.sources import features, tables, upsert

# Published zone areas: zone | publisher | number | legal form | id | start | end | car rule.
AREAS = """\
TOULOUSE|Toulouse Métropole|243100518|Métropole|243100518-ZFE-001|2022-03-01||
TOULOUSE|Toulouse Métropole|243100518|Métropole|243100518-ZFE-003|2023-01-01||V4
TOULOUSE|Toulouse Métropole|243100518|Métropole|243100518-ZFE-004|2024-01-01||V4
TOULOUSE|Toulouse Métropole|243100518|Métropole|243100518-ZFE-002|2022-09-01||
LYON|SM des transports pour le Rhône et l'agglomération lyonnaise (SYTRAL)|256900994|Établissement Public|200046977-ZFE-001|2025-01-01||V3
ANNECY|CA du Grand Annecy|200066793|Communauté d'agglomération|1|2025-01-01|2027-12-31|NC
ANNECY|CA du Grand Annecy|200066793|Communauté d'agglomération|2|2028-01-01|2028-12-31|V5
ANNECY|CA du Grand Annecy|200066793|Communauté d'agglomération|4|2030-01-01|2034-12-31|V3
ANNECY|CA du Grand Annecy|200066793|Communauté d'agglomération|3|2029-01-01|2029-12-31|V4
CLERMONT-FERRAND|Clermont Auvergne métropole|246300701|Métropole|246300701-ZFE-001|2023-07-01||
BORDEAUX|Bordeaux Métropole|243300316|Métropole|243300316-ZFE-001|2025-01-01|2999-12-31|NC
"""
IDS = """\
siren;code;epci_principal;autres_siren;forme_juridique
200066793;ANNECY;Grand Annecy;;Communauté d'agglomération
243300316;BORDEAUX;Bordeaux Métropole;;Métropole
246300701;CLERMONT-FERRAND;Clermont Auvergne métropole;;Métropole
200046977;LYON;Métropole de Lyon;256900994;Métropole
243100518;TOULOUSE;Toulouse Métropole;253100986;Métropole
"""
D = dt.date
META = {  # zone: first start, last start, first end, areas, car rule, number found in the id table, other number
    "ANNECY": (D(2025, 1, 1), D(2030, 1, 1), D(2027, 12, 31), 4, True, 200066793, None),
    "BORDEAUX": (D(2025, 1, 1), D(2025, 1, 1), None, 1, True, 243300316, None),
    "CLERMONT-FERRAND": (D(2023, 7, 1), D(2023, 7, 1), None, 1, False, 246300701, None),
    "LYON": (D(2025, 1, 1), D(2025, 1, 1), None, 1, True, None, None),
    "TOULOUSE": (D(2022, 3, 1), D(2024, 1, 1), None, 4, True, 243100518, "253100986"),
}


def area_features():
    for line in AREAS.splitlines():
        zone, name, number, form, area, start, end, rule = line.split("|")
        props = {"id": area, "date_debut": start, "vp_critair": rule or None, "date_fin": end or None,
                 "Shape_Area": 1.5, "SHAPE_Area": 2, "shape_area": None, "nested": {"lat": 1}}
        yield {"type": "Feature", "properties": props,
               "publisher": {"zfe_id": zone, "nom": name, "siren": int(number), "forme_juridique": form},
               "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "areas.geojson").write_text(
        json.dumps({"type": "FeatureCollection", "features": list(area_features())}, indent=1), encoding="utf-8")
    (tmp_path / "ids.csv").write_text(IDS, encoding="utf-8")
    return tmp_path


def test_zone_tables_reproduce_the_published_summary(spark, folder):
    built = build_zone_tables(spark, str(folder / "areas.geojson"), None, str(folder / "ids.csv"), str(folder / "out"))
    rows = {r.publisher_zfe_id: r for r in spark.read.parquet(str(folder / "out/meta")).collect()}
    got = {z: (r.first_date_debut, r.last_date_debut, r.first_date_fin, r.n_aires, r.has_vp_restriction, r.siren, r.autres_siren)
           for z, r in rows.items()}
    assert got == META
    assert built.areas.columns == list(clean.AREA_COLUMNS) and built.areas.count() == 11
    assert built.areas.filter("id = '243300316-ZFE-001'").first().date_fin is None


def test_road_segments_and_lines_format(spark, folder):
    (folder / "lines.json").write_text("\n".join(json.dumps(f) for f in area_features()), encoding="utf-8")
    built = build_zone_tables(spark, str(folder / "lines.json"), str(folder / "lines.json"), str(folder / "ids.csv"), lines=True)
    assert built.roads.columns == list(clean.ROAD_COLUMNS) and built.roads.count() == 11
    assert built.meta.count() == 5


def test_flatten_keeps_case_variants_and_lets_the_publisher_win(spark, folder):
    (folder / "f.json").write_text(json.dumps({"features": [
        {"properties": {"a": 1, "A": "x", "publisher_nom": "wrong"}, "publisher": {"nom": "right"}},
        {"properties": None, "publisher": {"nom": "only"}}, {"properties": {"a": None}, "publisher": None}, {}]}))
    rows = features.read_features(spark, str(folder / "f.json"))
    keys = [r.key for r in features.attribute_keys(rows).collect()]
    assert keys == ["A", "a", "publisher_nom"]
    flat = features.flatten_features(rows, ["a", "publisher_nom", "none"]).collect()
    assert [tuple(r) for r in flat] == [("1", "right", None), (None, "only", None), (None, None, None), (None, None, None)]


def test_collection_without_features_is_empty(spark, folder):
    (folder / "e.json").write_text('{"type": "FeatureCollection"}')
    assert features.read_features(spark, str(folder / "e.json")).count() == 0


def test_delimited_text_with_doubled_quotes_and_null_words(spark, folder):
    (folder / "t.csv").write_text('a;b\n1;"say ""hi""; ok"\nNA;\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_table(spark, str(folder / "t.csv"), ";").collect()] == [("1", 'say "hi"; ok'), (None, None)]


def test_panel_round_trip_prunes_years(spark, folder):
    rows = [("A ", D(2019, 12, 31), float("nan")), ("A ", D(2020, 1, 1), 2.0), ("B", D(2020, 1, 1), 3.0)]
    tables.write_panel(spark.createDataFrame(rows, "station_id string, date date, value double"), str(folder / "p"))
    back = tables.read_panel(spark, str(folder / "p"))
    assert sorted((r.station_id, r.date.year, r.value) for r in back.collect() if r.value) == [("A", 2020, 2.0), ("B", 2020, 3.0)]
    assert back.filter("value IS NULL").count() == 1
    assert {p.name for p in (folder / "p").iterdir() if p.is_dir()} == {"year=2019", "year=2020"}


def test_upsert_existing_wins_and_is_idempotent(spark):
    schema = "k string, d int, v string"
    base = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], schema)
    new = spark.createDataFrame([("a", 1, "new"), ("c", 1, "new"), ("c", 1, "newer")], schema)
    once = upsert.upsert_keep_first(base, new, ["k", "d"])
    assert sorted(tuple(r) for r in once.collect()) == [("a", 1, "old"), ("b", 1, "old"), ("c", 1, "new")]
    assert sorted(map(tuple, upsert.upsert_keep_first(once, new, ["k", "d"]).collect())) == sorted(map(tuple, once.collect()))
    assert upsert.upsert_keep_first(None, new, ["k", "d"]).count() == 2


def raw_rows(spark, rows):
    columns = ["﻿Date de début", "Polluant", "code site", "nom site", "type d'implantation", "type d'influence",
               "valeur", "Latitude", "Longitude"]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def test_clean_export_and_guards(spark):
    row = ("2020/01/02 00:00", "NO2", " FR1 ", "n", "e", "i", "12.5", "45.1", "5.7")
    got = clean.clean_export(raw_rows(spark, [row])).first()
    assert tuple(got) == (D(2020, 1, 2), "FR1", "n", "e", "i", 12.5, 45.1, 5.7)
    with pytest.raises(PySparkException, match="not a date"):
        clean.clean_export(raw_rows(spark, [("soon", *row[1:])])).collect()
    with pytest.raises(ValueError, match="Date de début"):
        clean.clean_export(raw_rows(spark, [row]).drop("﻿Date de début"))
    other = raw_rows(spark, [row, (row[0], "PM10", *row[2:]), (row[0], None, *row[2:])])
    with pytest.raises(PySparkException, match="PM10"):
        clean.require_single(other).collect()
    assert clean.filter_pollutant(other).count() == 1
    assert clean.require_single(other.drop("Polluant")).count() == 3


def test_dates_out_of_range_or_unreadable_are_null(spark):
    df = spark.createDataFrame([("2999-12-31",), ("2262-04-11",), ("x",), (None,), ("2020-02-30",), ("1677-09-21",)], "d string")
    got = [r.d for r in clean.parse_dates_lenient(df, ["d"]).collect()]
    assert got == [None, D(2262, 4, 11), None, None, None, None]


def test_raw_export_to_flagged_filled_panel(spark):
    rows = [(f"2020-01-{d:02d} 00:00", "NO2", s, s, "Urbain", "Fond", str(float(d)), lat, "0.5")
            for s, lat in (("IN", "0.2"), ("OUT", "5")) for d in (1, 2, 5)]
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}
    feats = spark.createDataFrame([({}, {"zfe_id": "Z"}, json.dumps(square))],
                                  "properties map<string,string>, publisher map<string,string>, geometry string")
    done = prepare(raw_rows(spark, rows), feats, "Z", 0.5)
    assert {r.station_id: r.in_zone for r in done.stations.collect()} == {"IN": True, "OUT": False}
    assert {r.station_id: r.missing_days for r in done.missing.collect()} == {"IN": 2, "OUT": 2}
    assert done.gaps.count() == 2 and done.dropped.count() == 0
    filled = done.filled.filter("station_id = 'IN'").orderBy("date").collect()
    assert [r.value for r in filled] == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert [r.zone for r in filled] == ["Z"] * 5 and [r.lat is None for r in filled] == [False, False, True, True, False]


def test_a_large_zone_has_several_collection_documents(spark, tmp_path, monkeypatch):
    from panelcf.registry import reading

    def put(name, schema, data):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("nation", "n_nationkey long, n_name string", [(0, "LARGE"), (1, "SMALL"), (2, None)])
    customers = [(k, f"c{k}", 0 if k < 90 else 1 + k % 2, "seg") for k in range(100)]
    put("customer", "c_custkey long, c_name string, c_nationkey long, c_mktsegment string", [*customers, customers[3]])
    put("orders", "o_custkey long, o_orderdate date", [(k, D(2020, 1, 1 + k % 28)) for k in range(100) for _ in range(2)])
    monkeypatch.setattr(reading, "DOCUMENT_AREAS", 10)
    monkeypatch.setattr(reading, "shared_dir", lambda *_: str(tmp_path / "collections"))
    got = reading.s1_collection(spark, str(tmp_path)).collect()
    names = {0: "LARGE", 1: "SMALL", 2: None}
    expected = [(names[n], f"A{k}", k) for k, _, n, _ in [*customers, customers[3]]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    files = {z.name: [f.read_text() for f in z.rglob("part-*")] for z in (tmp_path / "collections").iterdir() if z.name.startswith("z=")}
    assert len(files["z=LARGE"]) > 5 and len(files["z=SMALL"]) == 1
    assert all(len(json.loads(t)["features"]) < 40 for t in sum(files.values(), []))
