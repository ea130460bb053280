"""From feature collections and an id table to the zone tables, as one lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelcf.operators.clean import AREA_COLUMNS, ROAD_COLUMNS, parse_dates_lenient, project_keep
from panelcf.operators.zones import enrich_zones, zone_meta
from panelcf.sources.features import flatten_features, read_features
from panelcf.sources.tables import read_table, write_table

DATE_COLUMNS = ("date_debut", "date_fin")


@dataclass(frozen=True)
class ZoneTables:
    areas: DataFrame
    roads: DataFrame | None
    meta: DataFrame


def clean_zone_table(flat: DataFrame, columns=AREA_COLUMNS) -> DataFrame:
    """Keep-list projection, lenient dates, numeric publisher number."""
    kept = parse_dates_lenient(project_keep(flat, columns), DATE_COLUMNS)
    return kept.withColumn("publisher_siren", kept["publisher_siren"].try_cast("bigint"))


def zone_tables(areas_flat: DataFrame, roads_flat: DataFrame | None, ids: DataFrame) -> ZoneTables:
    areas = clean_zone_table(areas_flat)
    roads = None if roads_flat is None else clean_zone_table(roads_flat, ROAD_COLUMNS)
    typed_ids = ids.withColumn("siren", ids["siren"].cast("bigint"))
    return ZoneTables(areas, roads, enrich_zones(zone_meta(areas), typed_ids))


def build_zone_tables(spark: SparkSession, areas_path: str, roads_path: str | None, ids_path: str,
                      out: str | None = None, lines: bool = False, ids_sep: str = ";",
                      fmt: str = "parquet") -> ZoneTables:
    """Read, flatten, clean, aggregate, enrich; written below ``out`` if given.

    Only keep-list attributes are taken out of the property maps, so the open
    schema of the features is never discovered.
    """
    areas = flatten_features(read_features(spark, areas_path, lines), list(AREA_COLUMNS))
    roads = None
    if roads_path is not None:
        roads = flatten_features(read_features(spark, roads_path, lines), list(ROAD_COLUMNS))
    tables = zone_tables(areas, roads, read_table(spark, ids_path, ids_sep))
    if out is not None:
        for name, table in (("areas", tables.areas), ("roads", tables.roads), ("meta", tables.meta)):
            if table is not None:
                write_table(table, f"{out}/{name}", fmt)
    return tables
