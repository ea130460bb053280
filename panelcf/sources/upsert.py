"""Append rows to a table; a row already there wins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcf.functions.columns import HOUSE, PanelCols
from panelcf.session import shared_dir
from panelcf.sources.tables import stored, write_panel


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order``, then by the remaining columns.

    A plain aggregation, so copies of a frequent key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    ranked = F.struct(*[F.col(f"`{c}`") for c in [*[o for o in order if o not in keys], *rest]])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*[
        F.col(f"`{c}`") if c in keys else F.col(f"_best.`{c}`").alias(c) for c in df.columns
    ])


def upsert_keep_first(base: DataFrame | None, new: DataFrame, keys: list[str],
                      order: list[str] | None = None) -> DataFrame:
    """``base`` plus the rows of ``new`` whose key is not there yet, one row per key.

    ``order`` picks the row when one side repeats a key; missing columns become null.
    """
    ranked = new.withColumn("_source", F.lit(1))
    if base is not None:
        ranked = base.withColumn("_source", F.lit(0)).unionByName(ranked, allowMissingColumns=True)
    return first_per_key(ranked, keys, ["_source", *(order or [])]).drop("_source")


def upsert_panel(spark: SparkSession, path: str, new: DataFrame, order: list[str] | None = None,
                 cols: PanelCols = HOUSE) -> dict[int | None, int]:
    """Add to the panel stored at ``path`` the rows of ``new`` whose station and date are not there yet.

    The result is the number of rows added by year; a second run with the same rows adds none. Because a
    stored row always wins, files that exist are never touched: only the years in ``new`` are read, of them only keys between
    the batch's least and greatest station and date, and absent rows are written as further files of their years. A path
    without a panel is created. ``order`` picks the row when ``new`` repeats a key; a null station or date is a key like others;
    missing columns become null, columns the panel does not have are an error.

    One batch at a time: two that run at once may both add a key.
    """
    keys = [cols.id, cols.date]
    try:
        base = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        base = None
    if base is not None:
        new = _like(new, base)
    typed = new.withColumn(cols.date, F.col(cols.date).cast("date"))
    batch = stored(first_per_key(typed, keys, order or []).withColumn("year", F.year(cols.date)), shared_dir(spark, "batch"))
    if base is not None:
        there = base.filter(_near(batch, cols)).select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [batch[k].eqNullSafe(there[f"_{k}"]) for k in keys]
        batch = stored(batch.join(there, same, "left_anti"), shared_dir(spark, "absent"))
    added = {r["year"]: r["count"] for r in batch.groupBy("year").count().collect()}  # a row per year of the calendar
    if added or base is None:
        write_panel(batch.drop("year"), path, cols, mode="append")
    return added


def compact_years(spark: SparkSession, path: str, years, cols: PanelCols = HOUSE) -> None:
    """Rewrite the named years of a stored panel in order, after many small batches; other years keep their files."""
    rows = spark.read.parquet(path).filter(F.col("year").isin([int(y) for y in years]))
    staged = stored(rows, shared_dir(spark, "compact"))
    spread = staged.repartitionByRange("year", cols.id, cols.date).sortWithinPartitions("year", cols.id, cols.date)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def _like(new: DataFrame, base: DataFrame) -> DataFrame:
    """The batch with the panel's columns and types."""
    types = {f.name: f.dataType for f in base.schema.fields if f.name != "year"}
    unknown = [c for c in new.columns if c not in types]
    if unknown:
        raise ValueError(f"the stored panel has no columns {unknown}")
    return new.select(*[(F.col(f"`{c}`") if c in new.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _near(batch: DataFrame, cols: PanelCols):
    """The condition on stored rows that any key of the batch fulfils: its years, and its least and greatest keys."""
    ends = [f(c).alias(f"{name}_{c}") for c in (cols.id, cols.date) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    found = batch.agg(F.collect_set("year").alias("years"), *ends).first()
    near = F.col("year").isin(found["years"]) | F.col("year").isNull()
    for c in (cols.id, cols.date):
        near &= F.col(c).between(F.lit(found[f"lo_{c}"]), F.lit(found[f"hi_{c}"])) | F.col(c).isNull()
    return near
