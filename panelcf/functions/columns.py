"""Column names of a panel and small helpers shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First and last day of a 64-bit nanosecond clock (fixed values). Dates beyond
# them are treated as "no date".
DATE_BOUNDS = ("1677-09-22", "2262-04-11")


@dataclass(frozen=True)
class PanelCols:
    """Names of the key, date and value columns of a long panel."""

    id: str = "station_id"
    date: str = "date"
    value: str = "value"

    @property
    def names(self) -> tuple[str, str, str]:
        return (self.id, self.date, self.value)


HOUSE = PanelCols()

# Descriptive columns of a station in the house format.
STATION_TEXT = ("station_name", "station_env", "station_influence")


def as_date(value) -> Column:
    """A date literal, or the given column / column name unchanged."""
    if isinstance(value, Column):
        return value
    text = str(value)
    if text[:1].isdigit():
        return F.lit(text[:10]).cast("date")
    return F.col(text)


def no_nan(column) -> Column:
    """NaN means missing in exported files; SQL aggregates need NULL."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(column), column)


def present(df: DataFrame, names) -> list[str]:
    return [name for name in names if name in df.columns]


def id_list(ids) -> list[str]:
    """One id or several ids, as a list without repeats."""
    if isinstance(ids, (str, bytes)) or not hasattr(ids, "__iter__"):
        ids = [ids]
    return list(dict.fromkeys(ids))
