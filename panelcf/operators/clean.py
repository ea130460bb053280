"""Projection, filtering and typing of raw exports and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcf.functions.columns import (
    DATE_BOUNDS, HOUSE, STATION_TEXT, PanelCols, as_date, id_list, no_nan,
)
from panelcf.functions.periods import is_post, is_post_ex, is_pre
from panelcf.sources.upsert import first_per_key

# Headers of a monitoring-network export and their panel names (fixed values).
EXPORT_HEADERS = {
    "code site": "station_id",
    "nom site": "station_name",
    "type d'implantation": "station_env",
    "type d'influence": "station_influence",
    "valeur": "value",
    "Latitude": "lat",
    "Longitude": "lon",
}
EXPORT_DATE = "Date de début"
EXPORT_POLLUTANT = "Polluant"

# Columns kept of area and road-segment tables (fixed values).
AREA_COLUMNS = (
    "publisher_zfe_id", "publisher_nom", "publisher_siren", "publisher_forme_juridique", "id",
    "date_debut", "date_fin", "vp_critair", "vp_horaires", "vul_critair", "vul_horaires",
    "pl_critair", "pl_horaires", "autobus_autocars_critair", "autobus_autocars_horaires",
    "deux_rm_critair", "deux_rm_horaires", "url_arrete", "url_site_information",
)
ROAD_COLUMNS = (
    "publisher_zfe_id", "publisher_nom", "publisher_siren", "publisher_forme_juridique", "id",
    "osm_id", "ref", "one_way", "date_debut", "date_fin", "vp_critair", "vp_horaires",
    "vul_critair", "vul_horaires", "pl_critair", "pl_horaires", "autobus_autocars_critair",
    "autobus_autocars_horaires", "deux_rm_critair", "deux_rm_horaires", "zfe_derogation",
    "url_arrete", "url_site", "url_site_information",
)


def find_column(df: DataFrame, contains: str) -> str:
    """Name of the first column that contains ``contains``."""
    for name in df.columns:
        if contains in name:
            return name
    raise ValueError(f"no column name contains {contains!r}; columns are {df.columns}")


def _ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def date_or_null(column: Column, bounds: tuple[str, str] | None = DATE_BOUNDS) -> Column:
    """Text to date; what cannot be read, or lies outside ``bounds``, becomes null.

    Year first, parts separated by ``-`` or ``/``, with or without a time of day.
    """
    text = F.translate(F.trim(column.cast("string")), "/", "-")
    parsed = text.try_cast("timestamp_ntz").cast("date")
    if bounds is None:
        return parsed
    return F.when(parsed.between(as_date(bounds[0]), as_date(bounds[1])), parsed)


def date_or_error(column: Column) -> Column:
    """Text to date; a text that cannot be read stops the job."""
    parsed = date_or_null(column, None)
    bad = column.isNotNull() & parsed.isNull()
    message = F.concat(F.lit("not a date: "), column.cast("string"))
    return F.when(bad, F.raise_error(message).cast("date")).otherwise(parsed)


def parse_dates_lenient(df: DataFrame, columns, bounds=DATE_BOUNDS) -> DataFrame:
    return df.withColumns({c: date_or_null(_ref(c), bounds) for c in columns})


def require_single(df: DataFrame, column: str = EXPORT_POLLUTANT, expected: str = "NO2") -> DataFrame:
    """Stop the job at the first other value; a missing column or null is accepted.

    The check rides along with the scan instead of running a query of its own.
    """
    if column not in df.columns:
        return df
    value = _ref(column)
    message = F.concat(F.lit(f"unexpected value in {column}: "), value.cast("string"))
    return df.filter(
        F.when(value.isNull() | (value == F.lit(expected)), F.lit(True))
        .otherwise(F.raise_error(message).cast("boolean"))
    )


def filter_pollutant(df: DataFrame, column: str = EXPORT_POLLUTANT, expected: str = "NO2") -> DataFrame:
    """Keep one pollutant instead of refusing the others."""
    return df.filter(_ref(column) == F.lit(expected))


def trimmed_id(column: Column) -> Column:
    return F.trim(column.cast("string"))


def clean_export(raw: DataFrame, headers: dict[str, str] | None = None,
                 date_header: str = EXPORT_DATE, ordered: bool = False) -> DataFrame:
    """Raw export to the eight-column house format.

    ``ordered`` sorts the whole result by station and date, which costs a range
    shuffle; leave it off when the panel feeds further operators.
    """
    headers = headers or EXPORT_HEADERS
    named = {panel: _ref(source) for source, panel in headers.items()}
    out = raw.select(
        date_or_error(_ref(find_column(raw, date_header))).alias("date"),
        trimmed_id(named["station_id"]).alias("station_id"),
        *[named[c].cast("string").alias(c) for c in STATION_TEXT],
        *[no_nan(named[c].cast("double")).alias(c) for c in ("value", "lat", "lon")],
    )
    return out.orderBy("station_id", "date") if ordered else out


def project_keep(df: DataFrame, columns=AREA_COLUMNS) -> DataFrame:
    return df.select(*[_ref(c) for c in columns])


def with_zone(m: DataFrame, zone: str) -> DataFrame:
    return m.withColumn("zone", F.lit(zone))


def find_station(m: DataFrame, pattern: str, fallback: str | None = None) -> DataFrame:
    """The station whose name contains ``pattern`` (any case), else ``fallback``.

    Of several matches the smallest id wins. No match at all stops the job.
    """
    name = F.lower(F.col("station_name"))
    rank = F.when(name.contains(pattern.lower()), 0)
    if fallback is not None:
        rank = rank.when(name.contains(fallback.lower()), 1)
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "station_id", "station_name")))
    missing = F.raise_error(F.lit(f"no station name contains {pattern!r}"))
    hit = m.agg(best.alias("b"))
    return hit.select(
        F.when(F.col("b").isNull(), missing.cast("string"))
        .otherwise(F.col("b.station_id").cast("string")).alias("station_id"),
        F.col("b.station_name"),
    )


def keep_ids(m: DataFrame, ids, cols: PanelCols = HOUSE) -> DataFrame:
    """Rows of the listed stations; ``ids`` is a list or a DataFrame with the id column."""
    if isinstance(ids, DataFrame):
        return m.join(ids.select(cols.id).distinct(), cols.id, "left_semi")
    return m.filter(F.col(cols.id).isin(id_list(ids)))


def tag_period(m: DataFrame, start, window=None, cols: PanelCols = HOUSE) -> DataFrame:
    """Flags ``is_pre``, ``is_post`` and ``is_post_ex`` in one scan."""
    date = F.col(cols.date)
    return m.withColumns({
        "is_pre": is_pre(date, start),
        "is_post": is_post(date, start),
        "is_post_ex": is_post_ex(date, start, window),
    })


def clip_dates(m: DataFrame, low, high, cols: PanelCols = HOUSE) -> DataFrame:
    return m.filter(F.col(cols.date).between(as_date(low), as_date(high)))


def stations(m: DataFrame, columns=None, one_per_id: bool = False, cols: PanelCols = HOUSE) -> DataFrame:
    """Distinct station descriptions; ``one_per_id`` keeps the smallest description of an id."""
    columns = columns or [c for c in (*STATION_TEXT,) if c in m.columns]
    picked = m.select(cols.id, *columns)
    return first_per_key(picked, [cols.id], []) if one_per_id else picked.distinct()


def drop_empty_series(m: DataFrame, cols: PanelCols = HOUSE) -> DataFrame:
    """Remove stations that have no value at all."""
    filled = m.filter(F.col(cols.value).isNotNull()).select(cols.id).distinct()
    return m.join(filled, cols.id, "left_semi")


def complete_dates(m: DataFrame, cols: PanelCols = HOUSE, group: str | None = None) -> DataFrame:
    """Keep the dates on which every series (of the group) has a value.

    Counted per date in long form: no pivot, and the counts are tiny.
    """
    m = m if group else m.withColumn("_g", F.lit(1))
    g = group or "_g"
    series = m.select(g, cols.id).distinct().groupBy(g).agg(F.count(F.lit(1)).alias("_n"))
    full = (
        m.filter(F.col(cols.value).isNotNull()).select(g, cols.date, cols.id).distinct()
        .groupBy(g, cols.date).agg(F.count(F.lit(1)).alias("_k"))
        .join(series, g).filter(F.col("_k") == F.col("_n")).select(g, cols.date)
    )
    kept = m.join(full, [g, cols.date], "left_semi")
    return kept if group else kept.drop("_g")


def align_dates(left: DataFrame, right: DataFrame, how: str = "inner", date: str = "date") -> DataFrame:
    """Two date-keyed series side by side on their common dates (or all left dates)."""
    return left.join(right, date, how)


def common_dates(left: DataFrame, right: DataFrame, date: str = "date") -> DataFrame:
    """Dates present in both."""
    return left.select(date).intersect(right.select(date))


def union_panels(*parts: DataFrame) -> DataFrame:
    """Stack panels by column name; a column missing somewhere is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
