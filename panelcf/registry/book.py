"""The registry: name -> (query, SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Round all DOUBLE columns, so that summation order does not show.

    Means of few exact values often end in a 5 right behind the last digit kept.
    A nudge far below that digit moves them off the tie; the SQL adds the same.
    ``other`` gives single columns their own number of digits.
    """
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    keep = {c: other.get(c, digits) for c in doubles}
    return df.withColumns({c: F.round(F.col(f"`{c}`") + 3 * 10.0 ** -(d + 3), d) for c, d in keep.items()}) if keep else df
