"""Which stations lie inside a zone, and the table behind a station map.

Point in polygon in two equi-joins. A polygon's box covers a few cells of a grid
whose step suits the size of the box; a point meets the polygons of its own cell on
every step in use. Point and polygon then meet the polygon's edges at the point's
latitude; counting the edges to its right gives the even-odd rule.

A point on a border is inside the union if the polygons together surround it: the
directions that they fill at the point are merged and must make a full turn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcf.functions.columns import id_list
from panelcf.functions.mercator import mercator_x, mercator_y

_RING = T.ArrayType(T.ArrayType(T.DoubleType()))
_POLYGON = T.StructType([T.StructField("type", T.StringType()),
                         T.StructField("coordinates", T.ArrayType(_RING))])
_MULTI = T.StructType([T.StructField("type", T.StringType()),
                       T.StructField("coordinates", T.ArrayType(T.ArrayType(_RING)))])
_COLLECTION = T.StructType([T.StructField("type", T.StringType()),
                            T.StructField("geometries", T.ArrayType(T.StringType()))])

BAND_DEGREES = 0.05
FINEST = 14  # steps of the grid: 360 degrees halved this many times at most
_TURN = 2 * math.pi


def zone_edges(features: DataFrame, zone_key: str = "zfe_id") -> DataFrame:
    """Polygon edges per zone: ``zone, polygon, ring, x1, y1, x2, y2``, the inside on their left.

    A multi-polygon or a collection gives several polygons; holes are further rings of
    a polygon. A feature without geometry has no edges; any other geometry is an error.
    Polygons are named by their content, so a repeated feature counts once.
    """
    kind = F.get_json_object("geometry", "$.type")
    distinct = (
        features.select(
            F.element_at("publisher", F.lit(zone_key)).alias("zone"),
            F.md5("geometry").alias("_feature"), "geometry",
        ).groupBy("zone", "_feature").agg(F.min("geometry").alias("geometry"))
    )
    strict = {"mode": "FAILFAST"}
    members = F.from_json("geometry", _COLLECTION, strict)["geometries"]
    single = distinct.filter(F.col("zone").isNotNull() & F.col("geometry").isNotNull()).select(
        "zone", "_feature", F.explode(F.when(kind == "GeometryCollection", members).otherwise(F.array("geometry"))).alias("geometry"))
    other = F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("no type"))))
    shapes = single.select(
        "zone", F.concat_ws("-", "_feature", F.md5("geometry")).alias("_feature"),
        F.when(kind == "Polygon", F.array(F.from_json("geometry", _POLYGON, strict)["coordinates"]))
        .when(kind == "MultiPolygon", F.from_json("geometry", _MULTI, strict)["coordinates"])
        .otherwise(other.cast(_MULTI["coordinates"].dataType))
        .alias("polygons"),
    )
    polygons = shapes.select("zone", "_feature", F.posexplode("polygons").alias("_part", "rings"))
    rings = polygons.select(
        "zone", F.concat_ws("-", "_feature", "_part").alias("polygon"), F.posexplode("rings").alias("at", "way")
    ).filter(F.size("way") > 1)
    pairs = F.arrays_zip(
        F.slice("way", 1, F.size("way") - 1).alias("a"), F.slice("way", 2, F.size("way") - 1).alias("b")
    )
    listed = rings.select("zone", "polygon", F.col("at").alias("ring"), pairs.alias("pairs"))
    area = F.aggregate("pairs", F.lit(0.0), lambda t, e: t + e["a"][0] * e["b"][1] - e["b"][0] * e["a"][1])
    # the first ring is the outer one and runs counter-clockwise, holes run clockwise
    turned = listed.withColumn("turn", (area < 0) == (F.col("ring") == 0))
    edges = turned.select("zone", "polygon", "ring", "turn", F.explode("pairs").alias("e")).select(
        "zone", "polygon", "ring",
        F.when(F.col("turn"), F.col("e.b")).otherwise(F.col("e.a")).alias("a"),
        F.when(F.col("turn"), F.col("e.a")).otherwise(F.col("e.b")).alias("b"),
    )
    x1, y1, x2, y2 = (_degrees(F.col(end)[k], 360 - 270 * k) for end in "ab" for k in (0, 1))
    return edges.select("zone", "polygon", "ring", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _degrees(value: Column, limit: int) -> Column:
    """The coordinate, or an error beyond the range of degrees (metres, say).

    Longitudes may run on past 180, as they do in zones across the date line.
    """
    beyond = F.raise_error(F.lit(f"a coordinate beyond {limit} degrees")).cast("double")
    return F.when(F.abs(value) > limit, beyond).otherwise(value)


def _band(lat: Column, size: float) -> Column:
    return F.floor(lat / F.lit(size)).cast("long")


def _cell(value: Column, step: Column) -> Column:
    """Number of the cell along one axis on a step of the grid."""
    return F.floor((value + 180) / 360 * F.pow(F.lit(2.0), step)).cast("long")


def _candidates(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """Points with the polygons whose box holds them. A box has at most nine cells on its step."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    boxes = edges.groupBy("zone", "polygon").agg(
        F.min(F.least(x1, x2)).alias("west"), F.max(F.greatest(x1, x2)).alias("east"),
        F.min(F.least(y1, y2)).alias("south"), F.max(F.greatest(y1, y2)).alias("north"),
    )
    size = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(360 / 2**FINEST))
    step = F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(360.0) / size)).cast("int")))
    on_step = boxes.withColumn("_step", step)
    along = [F.explode(F.sequence(_cell(F.col(low), F.col("_step")), _cell(F.col(high), F.col("_step"))))
             for low, high in (("west", "east"), ("south", "north"))]
    cells = on_step.withColumn("_i", along[0]).withColumn("_j", along[1])
    steps = on_step.agg(F.sort_array(F.collect_set("_step")).alias("s")).scalar()  # FINEST + 1 numbers at most
    placed = spots.withColumn("_step", F.explode(steps)).withColumns({
        "_i": _cell(F.col("lon"), F.col("_step")), "_j": _cell(F.col("lat"), F.col("_step")),
    })
    held = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return placed.join(cells, ["_step", "_i", "_j"]).filter(held).select("lon", "lat", "zone", "polygon")


def _surrounded(fills: Column) -> Column:
    """Do intervals of directions (start in [0, turn), length), sorted, cover the full turn?"""
    first = fills[0]
    state = F.struct(first["start"].alias("reach"), F.lit(True).alias("whole"))
    merged = F.aggregate(fills, state, lambda t, f: F.struct(
        F.greatest(t["reach"], f["start"] + f["length"]).alias("reach"),
        (t["whole"] & (f["start"] <= t["reach"] + 1e-9)).alias("whole")))
    return merged["whole"] & (merged["reach"] >= first["start"] + _TURN - 1e-9)


def points_in_zones(points: DataFrame, edges: DataFrame, band: float = BAND_DEGREES) -> DataFrame:
    """Distinct ``(lon, lat, zone)`` where the point is inside the union of the zone's polygons.

    A point on the border of the union is outside; one on a border that two of its
    polygons share is inside.
    """
    spots = points.select("lon", "lat").dropna().distinct().select(
        _degrees(F.col("lon"), 360).alias("lon"), _degrees(F.col("lat"), 90).alias("lat"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.withColumn("_band", F.explode(F.sequence(_band(low, band), _band(high, band))))
    near = _candidates(spots, edges).withColumn("_band", _band(F.col("lat"), band))
    x, y = F.col("lon"), F.col("lat")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    straddles = (y1 > y) != (y2 > y)
    cross = F.when(straddles, x < (x2 - x1) * (y - y1) / (y2 - y1) + x1).otherwise(F.lit(False))
    on_edge = (
        ((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1))
        & x.between(F.least(x1, x2), F.greatest(x1, x2))
        & y.between(low, high)
    )
    met = near.join(banded, ["zone", "polygon", "_band"]).filter((y >= low) & (y <= high) & (x <= F.greatest(x1, x2)))
    # the directions from the point along the edges that hold it: what lies left of the outgoing one is inside
    starts, ends = (x == x1) & (y == y1), (x == x2) & (y == y2)
    out = F.when(on_edge & ~ends, F.atan2(y2 - y, x2 - x))
    back = F.when(on_edge & ~starts, F.atan2(y1 - y, x1 - x))
    per_ring = met.groupBy("lon", "lat", "zone", "polygon", "ring").agg(
        F.count_if(cross).alias("crossings"), F.bool_or(on_edge).alias("border"),
        F.max(out).alias("out"), F.max(back).alias("back"),
    )
    fill = F.when(F.col("out").isNotNull() & F.col("back").isNotNull(), F.struct(
        F.pmod("out", F.lit(_TURN)).alias("start"), F.pmod(F.col("back") - F.col("out"), F.lit(_TURN)).alias("length")))
    per_polygon = per_ring.groupBy("lon", "lat", "zone", "polygon").agg(
        F.sum("crossings").alias("crossings"), F.bool_or("border").alias("border"), F.collect_list(fill).alias("fills"),
    )
    inside = (F.col("crossings") % 2 == 1) & ~F.col("border")
    # only the polygons that touch at one point are listed together
    per_zone = per_polygon.groupBy("lon", "lat", "zone").agg(
        F.bool_or(inside).alias("inside"), F.sort_array(F.flatten(F.collect_list("fills"))).alias("fills"))
    around = F.when(F.size("fills") > 1, _surrounded(F.col("fills"))).otherwise(F.lit(False))
    return per_zone.filter(F.col("inside") | around).select("lon", "lat", "zone")


def flag_in_zone(stations: DataFrame, features: DataFrame, zone: str, out: str = "in_zone",
                 zone_key: str = "zfe_id", band: float = BAND_DEGREES) -> DataFrame:
    """Stations with a boolean: strictly inside the union of the zone's polygons.

    A station without coordinates is outside. An unknown zone is an error.
    """
    wanted = features.filter(F.element_at("publisher", F.lit(zone_key)) == F.lit(zone))
    if wanted.isEmpty():
        raise ValueError(f"no feature belongs to zone {zone!r}")
    inside = points_in_zones(stations, zone_edges(wanted, zone_key), band).select(
        "lon", "lat", F.lit(True).alias("_in")
    )
    return stations.join(inside, ["lon", "lat"], "left").select(
        *stations.columns, F.coalesce("_in", F.lit(False)).alias(out)
    )


def station_map_table(stations: DataFrame, treated_ids=()) -> DataFrame:
    """Rows with coordinates, text ids, a treated flag and Web-Mercator metres."""
    placed = stations.dropna(subset=["lat", "lon"])
    ids = [str(i) for i in id_list(treated_ids)]
    return placed.withColumns({
        "station_id": F.col("station_id").cast("string"),
        "is_treated": F.col("station_id").cast("string").isin(ids),
        "x": mercator_x(F.col("lon")),
        "y": mercator_y(F.col("lat")),
    })
