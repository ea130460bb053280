"""Delimited tables and the stored long panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcf.functions.columns import HOUSE, PanelCols, no_nan

# Texts that exported files use for "no value" (fixed values).
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _quotes_closed(spark: SparkSession, path: str) -> Column:
    """True, or an error if a file has an odd number of quotes: the last text would swallow what follows it."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per_file = spark.read.text(path).groupBy(F.input_file_name()).agg((F.sum(quotes) % 2).alias("odd"))
    unclosed = F.raise_error(F.lit(f"an open quote in {path}")).cast("boolean")
    return per_file.agg(F.max("odd").alias("odd")).select(F.when(F.coalesce("odd", F.lit(0)) == 0, F.lit(True)).otherwise(unclosed)).scalar()


def read_table(spark: SparkSession, path: str, sep: str = ",", schema=None,
               multiline: bool = True) -> DataFrame:
    """Read a delimited file with a header; quotes inside quoted text are doubled.

    Without a schema every column is text (nothing is scanned to guess types).
    Quoted text may hold line breaks, which keeps a file in one task; without
    ``multiline`` large files are split, and a line break in a value is an error.
    A row with too few or too many values, as after an open quote, is an error.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"')
    reader = reader.option("escape", '"').option("multiLine", multiline)
    reader = reader.option("mode", "FAILFAST").option("columnPruning", False)
    closed = _quotes_closed(spark, path)
    if schema is not None:
        return reader.schema(schema).csv(path).filter(closed)
    table = reader.csv(path).filter(closed)
    return table.select(*[
        F.when(~F.col(f"`{c}`").isin(*NULL_TEXTS), F.col(f"`{c}`")).alias(c) for c in table.columns
    ])


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet", cols: PanelCols = HOUSE,
               sep: str = ",") -> DataFrame:
    """The stored long panel: text id, DATE, DOUBLE with NaN turned into NULL."""
    raw = spark.read.parquet(path) if fmt == "parquet" else read_table(spark, path, sep)
    typed = {
        cols.id: F.trim(F.col(cols.id).cast("string")),
        cols.date: F.col(cols.date).cast("date"),
        cols.value: no_nan(F.col(cols.value).cast("double")),
    }
    for name in ("lat", "lon"):
        if name in raw.columns:
            typed[name] = F.col(name).cast("double")
    return raw.withColumns(typed).drop("year")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_panel(df: DataFrame, path: str, cols: PanelCols = HOUSE, rows_per_file: int = 5_000_000,
                mode: str = "overwrite") -> None:
    """Store a panel split by year, so that date filters prune folders.

    Rows are dealt to tasks by ranges of year, station and date, so the number of
    tasks follows the size, and a large year or station takes as many as it needs.
    """
    spread = df.withColumn("year", F.year(cols.date)).repartitionByRange("year", cols.id, cols.date)
    ordered = spread.sortWithinPartitions("year", cols.id, cols.date)
    ordered.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("year").parquet(path)


def stored(df: DataFrame, path: str | None) -> DataFrame:
    """Write an intermediate table to a shared folder and continue from the files.

    It is then computed once, its lineage is short, and a lost executor costs a
    re-read, not a re-computation. Without a path the frame is returned as it is.
    """
    if path is None:
        return df
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
