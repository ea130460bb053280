"""Longitude / latitude (degrees) to Web-Mercator metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0  # fixed value of the projection


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))
