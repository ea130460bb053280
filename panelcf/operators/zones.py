"""Zone and station descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcf.functions.calendar import month_start
from panelcf.functions.columns import STATION_TEXT, present

ZONE_KEYS = ("publisher_zfe_id", "publisher_siren", "publisher_nom")


def zone_meta(areas: DataFrame, keys=ZONE_KEYS, begin: str = "date_debut", end: str = "date_fin",
              area_id: str = "id", restriction: str = "vp_critair") -> DataFrame:
    """One row per zone: first / last start, first end, number of areas, any restriction.

    Any non-null restriction text counts, also one that means "not concerned".
    Rows with a null key are left out.
    """
    known = areas
    for key in keys:
        known = known.filter(F.col(key).isNotNull())
    return known.groupBy(*keys).agg(
        F.min(begin).alias("first_date_debut"),
        F.max(begin).alias("last_date_debut"),
        F.min(end).alias("first_date_fin"),
        F.count_distinct(area_id).alias("n_aires"),
        F.bool_or(F.col(restriction).isNotNull()).alias("has_vp_restriction"),
    )


def enrich_zones(meta: DataFrame, ids: DataFrame, key: str = "publisher_siren",
                 ids_key: str = "siren") -> DataFrame:
    """Left join of the id table; whether it is broadcast follows from its size."""
    return meta.join(ids, meta[key] == ids[ids_key], "left")


def treatment_start(meta: DataFrame, zone=None, grain: str = "day", zone_col: str = "publisher_zfe_id",
                    begin: str = "first_date_debut") -> DataFrame:
    """First start date per zone, optionally moved to the first of its month."""
    picked = meta if zone is None else meta.filter(F.col(zone_col) == F.lit(zone))
    start = picked.groupBy(zone_col).agg(F.min(begin).alias("start"))
    return start.withColumn("start", month_start(F.col("start"))) if grain == "month" else start


def _first_known(column: str) -> Column:
    """Earliest non-null value, by date and then by value."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct("date", column)))[column]


def station_meta(m: DataFrame, text_cols=STATION_TEXT) -> DataFrame:
    """Most frequent name, surroundings and influence per station, first known position.

    Ties go to the smallest text. Rows are first counted per distinct description,
    so a station with very many rows is reduced before it is shuffled.
    """
    names = present(m, text_cols)
    shapes = m.groupBy("station_id", *names).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min(F.when(F.col(c).isNotNull(), F.struct("date", c))).alias(c) for c in ("lat", "lon")],
    )
    stacked = shapes.select(
        "station_id", "lat", "lon", F.col("_rows"),
        F.posexplode(F.array(*[F.col(n) for n in names])).alias("_which", "_text"),
    )
    counts = stacked.groupBy("station_id", "_which", "_text").agg(
        F.sum("_rows").alias("_rows"), F.min("lat").alias("lat"), F.min("lon").alias("lon"),
    )
    better = F.when(F.col("_text").isNotNull(), F.struct((-F.col("_rows")).alias("n"), F.col("_text").alias("t")))
    return counts.groupBy("station_id").agg(
        *[F.min(F.when(F.col("_which") == i, better))["t"].alias(n) for i, n in enumerate(names)],
        F.min("lat")["lat"].alias("lat"),
        F.min("lon")["lon"].alias("lon"),
    )


def station_meta_by_name(m: DataFrame, text_cols=STATION_TEXT) -> DataFrame:
    """One row per distinct description, with its first known position; null keys are left out."""
    keys = ["station_id", *present(m, text_cols)]
    known = m
    for key in keys:
        known = known.filter(F.col(key).isNotNull())
    return known.groupBy(*keys).agg(
        _first_known("lat").alias("lat"), _first_known("lon").alias("lon"),
    )


def attach_meta(m: DataFrame, meta: DataFrame, key: str = "station_id") -> DataFrame:
    """Give a derived panel its station descriptions back."""
    return m.join(meta, key, "left")


def donors_outside(m: DataFrame, flagged: DataFrame, flag: str = "in_zone") -> DataFrame:
    """Rows of the stations that are not in the zone."""
    outside = flagged.filter(~F.col(flag)).select("station_id").distinct()
    return m.join(outside, "station_id", "left_semi")
