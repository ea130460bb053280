"""Feature collections (GeoJSON) as rows, with open-ended properties kept as a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())

FEATURE = T.StructType([
    T.StructField("properties", _TEXT_MAP),
    T.StructField("publisher", _TEXT_MAP),
    T.StructField("geometry", T.StringType()),
])

#: A line end that no JSON in UTF-8 holds, so that a file is one line; in other encodings the pieces are broken JSON.
_NEVER = "\x00"

COLLECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(FEATURE)),
])


def _feature_rows(collections: DataFrame) -> DataFrame:
    return (
        collections.select(F.explode("features").alias("f"))
        .filter(F.col("f").isNotNull())
        .select("f.properties", "f.publisher", "f.geometry")
    )


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per feature: ``properties`` map, ``publisher`` map, ``geometry`` JSON text.

    A standard collection is one JSON document and so one task per file, of less
    than 2 GB. Large inputs should hold one feature per line (``lines=True``), which
    Spark splits. Broken JSON is an error, never a missing feature.
    """
    if lines:
        return spark.read.schema(FEATURE).json(path, mode="FAILFAST").select("properties", "publisher", "geometry")
    # with multiLine Spark would go back into the file for the text of each geometry, some 10 to 20 KB a time
    return _feature_rows(spark.read.schema(COLLECTION).json(path, lineSep=_NEVER, mode="FAILFAST"))


def parse_features(df: DataFrame, json_col: str) -> DataFrame:
    """Same rows from a column that already holds collection documents."""
    return _feature_rows(
        df.select(F.from_json(F.col(json_col), COLLECTION, {"mode": "FAILFAST"}).alias("c")).select("c.features")
    )


def attributes() -> Column:
    """Properties plus ``publisher_``-prefixed publisher keys; the publisher wins."""
    publisher = F.transform_keys(
        F.coalesce(F.col("publisher"), F.create_map().cast(_TEXT_MAP)),
        lambda k, _: F.concat(F.lit("publisher_"), k),
    )
    own = F.map_filter(
        F.coalesce(F.col("properties"), F.create_map().cast(_TEXT_MAP)),
        lambda k, _: ~F.map_contains_key(publisher, k),
    )
    return F.map_concat(own, publisher)


def attribute_keys(features: DataFrame) -> DataFrame:
    """Distinct attribute names, in alphabetical order."""
    return (
        features.select(F.explode(F.map_keys(attributes())).alias("key")).distinct().orderBy("key")
    )


def flatten_features(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One text column per attribute. Without ``keys`` the names are read from the data."""
    if keys is None:
        keys = [row.key for row in attribute_keys(features).collect()]
    flat = features.select(attributes().alias("a"))
    return flat.select(*[F.element_at("a", F.lit(k)).alias(k) for k in keys])
