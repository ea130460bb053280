"""Raw export to a flagged, gap-free panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from panelcf.operators.clean import clean_export, require_single, with_zone
from panelcf.operators.impute import interpolate_time
from panelcf.operators.quality import gap_intervals, missing_summary
from panelcf.operators.spatial import flag_in_zone
from panelcf.operators.zones import station_meta


@dataclass(frozen=True)
class Prepared:
    panel: DataFrame
    stations: DataFrame
    missing: DataFrame
    gaps: DataFrame
    filled: DataFrame
    dropped: DataFrame


def prepare(raw: DataFrame, features: DataFrame, zone: str, max_missing_ratio: float = 0.2) -> Prepared:
    """Clean, describe and flag the stations, report missing days, fill them."""
    panel = with_zone(clean_export(require_single(raw)), zone)
    filled, dropped = interpolate_time(panel, max_missing_ratio)
    return Prepared(
        panel=panel,
        stations=flag_in_zone(station_meta(panel), features, zone),
        missing=missing_summary(panel),
        gaps=gap_intervals(panel),
        filled=filled,
        dropped=dropped,
    )
