"""Point in polygon and exact quantiles against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcf.operators import spatial
from panelcf.operators.describe import box_outliers, box_stats
from panelcf.operators.quantiles import exact_quantiles

FEATURES = "properties map<string,string>, publisher map<string,string>, geometry string"


def feature(zone, geometry):
    return ({"id": "1"}, {"zfe_id": zone}, json.dumps(geometry))


def polygon(*rings):
    return {"type": "Polygon", "coordinates": [list(map(list, r)) for r in rings]}


SQUARE = ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
HOLE = ((1, 1), (3, 1), (3, 3), (1, 3), (1, 1))
SECOND = ((2, 2), (6, 2), (6, 6), (2, 6), (2, 2))


def flags(spark, features, points, zone="Z"):
    st = spark.createDataFrame([(str(i), x, y) for i, (x, y) in enumerate(points)], "station_id string, lon double, lat double")
    out = spatial.flag_in_zone(st, spark.createDataFrame(features, FEATURES), zone)
    return [r.in_zone for r in sorted(out.collect(), key=lambda r: int(r.station_id))]


def test_square_edges_corners_and_missing_position(spark):
    points = [(2.0, 2.0), (0.0, 2.0), (4.0, 2.0), (2.0, 4.0), (2.0, 0.0), (0.0, 0.0), (4.0, 4.0), (5.0, 2.0), (-1.0, 0.0), (None, 1.0)]
    assert flags(spark, [feature("Z", polygon(SQUARE))], points) == [True] + [False] * 9


def test_hole_is_outside(spark):
    points = [(2.0, 2.0), (0.5, 0.5), (1.0, 2.0), (0.5, 3.9), (3.5, 2.0)]
    assert flags(spark, [feature("Z", polygon(SQUARE, HOLE))], points) == [False, True, False, True, True]


def test_overlap_multi_polygon_other_zone_and_repeated_feature(spark):
    multi = {"type": "MultiPolygon", "coordinates": [polygon(SQUARE)["coordinates"], polygon(SECOND)["coordinates"]]}
    far = polygon(((50, 50), (60, 50), (60, 60), (50, 50)))
    feats = [feature("Z", multi), feature("Z", multi), feature("Y", far)]
    points = [(3.0, 3.0), (1.0, 1.0), (5.0, 5.0), (4.0, 3.0), (5.0, 1.0), (55.0, 52.0)]
    assert flags(spark, feats, points) == [True, True, True, True, False, False]


def test_shared_borders_belong_to_the_union(spark):
    left, right = polygon(((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))), polygon(((2, 0), (2, 2), (4, 2), (4, 0), (2, 0)))  # one runs clockwise
    points = [(2.0, 1.0), (2.0, 0.0), (2.0, 2.0), (0.0, 1.0), (1.0, 1.0), (3.0, 1.0), (4.0, 2.0)]
    assert flags(spark, [feature("Z", left), feature("Z", right)], points) == [True, False, False, False, True, True, False]
    four = [feature("Z", polygon(((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)))) for i in (0, 1) for j in (0, 1)]
    assert flags(spark, four, [(1.0, 1.0), (1.0, 0.0), (0.5, 1.0)]) == [True, False, True]
    assert flags(spark, four[:3], [(1.0, 1.0), (1.0, 0.5)]) == [False, True]
    # the same border seen twice from one side is still a border
    inner = polygon(((0, 0), (1, 0), (1, 2), (0, 2), (0, 0)))
    assert flags(spark, [feature("Z", left), feature("Z", inner)], [(0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]) == [False, True, False]
    # a hole that another polygon fills
    ring, plug = polygon(SQUARE, HOLE), polygon(HOLE)
    assert flags(spark, [feature("Z", ring), feature("Z", plug)], [(1.0, 2.0), (1.0, 1.0), (2.0, 2.0)]) == [True, True, True]


def test_large_and_small_boxes_and_coordinates_in_metres(spark):
    world, small = polygon(((-180, -90), (180, -90), (180, 90), (-180, 90), (-180, -90))), polygon(((10, 10), (10.001, 10), (10.001, 10.001), (10, 10)))
    assert flags(spark, [feature("Z", world)], [(0.0, 0.0), (179.9, -89.9), (180.0, 0.0)]) == [True, True, False]
    assert flags(spark, [feature("Z", small)], [(10.0007, 10.0005), (10.0002, 10.0005)]) == [True, False]
    with pytest.raises(Exception, match="a coordinate beyond"):
        flags(spark, [feature("Z", polygon(((0, 0), (500000, 0), (500000, 5000000), (0, 0))))], [(1.0, 1.0)])


def test_unknown_zone_is_an_error(spark):
    with pytest.raises(ValueError, match="no feature belongs"):
        flags(spark, [feature("Z", polygon(SQUARE))], [(0.0, 0.0)], "W")


def _inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("seed", range(3))
def test_random_star_polygons(spark, seed):
    rng = np.random.default_rng(seed)
    angles = np.sort(rng.uniform(0, 2 * np.pi, 40))
    radii = rng.uniform(0.3, 2.0, 40)
    ring = [(float(7 + r * np.cos(a)), float(-0.5 + r * np.sin(a))) for a, r in zip(angles, radii)]
    ring.append(ring[0])
    points = [(float(x), float(y)) for x, y in zip(rng.uniform(4.5, 9.5, 300), rng.uniform(-3, 2, 300))]
    assert flags(spark, [feature("Z", polygon(ring))], points) == [_inside(x, y, ring) for x, y in points]


def test_map_table_is_web_mercator(spark):
    st = spark.createDataFrame([("a", 2.35, 48.85), ("b", None, 1.0)], "station_id string, lon double, lat double")
    rows = spatial.station_map_table(st, ["a"]).collect()
    assert len(rows) == 1 and rows[0].is_treated
    assert rows[0].x == pytest.approx(261600.803, abs=0.01) and rows[0].y == pytest.approx(6249447.7, abs=1)


@pytest.mark.parametrize("ranges,rounds", [(4, 1), (64, 1), (5, 3)])
def test_exact_quantiles(spark, ranges, rounds):
    rng = np.random.default_rng(7)
    groups = {
        "hot": rng.normal(0, 1, 6000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]), "tail": np.exp(rng.normal(0, 4, 700)), "same": np.full(50, 2.5),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "v", probs, ranges, rounds).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, probs), rtol=1e-12, atol=1e-12)


def test_rounds_follow_the_largest_group(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(0, 1, 20_000)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0)], "g string, v double").repartition(5)
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5], ranges=8, longest=50).collect()}
    assert np.allclose(got["a"], np.quantile(values, [0.1, 0.5]), rtol=1e-12) and got["b"] == [1.0, 1.0]


def test_quantiles_never_gather_a_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("v"))
    plan = exact_quantiles(df, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "collect_list(v" not in plan and "percentile(v" not in plan


def test_box_stats_follow_the_usual_whisker_rule(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(10, 2, 200), [40.0, -30.0, 41.5]])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0)], "g string, v double")
    got = {r.g: r for r in box_stats(df, "g", "v").collect()}
    q1, med, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    a = got["a"]
    assert np.allclose([a.q1, a["median"], a.q3, a.whisker_low, a.whisker_high], [q1, med, q3, inside.min(), inside.max()])
    assert (a.n, a.n_outliers) == (203, 203 - len(inside))
    assert box_outliers(df, "g", "v").count() == a.n_outliers
    assert (got["b"].q1, got["b"].whisker_high, got["b"].n_outliers) == (1.0, 1.0, 0)
