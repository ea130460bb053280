"""The sample tables seen as panels, zones and stations, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcf.operators.describe import daily_mean

START, WINDOW = "1999-01-01", ("2000-03-01", "2000-06-30")
EVENT_START, EVENT_WINDOW = "2024-01-16", ("2024-01-20", "2024-01-22")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def user_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        _text("user_id").alias("station_id"), F.to_date("ts").alias("date"), "value"
    )


def p_user(spark, sf_dir) -> DataFrame:
    return daily_mean(user_rows(spark, sf_dir))


def p_type(spark, sf_dir) -> DataFrame:
    return daily_mean(table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station_id"), F.to_date("ts").alias("date"), "value"
    ))


def snation_rows(spark, sf_dir) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return table(spark, sf_dir, "lineitem").join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey")
    ).select(
        _text("s_nationkey").alias("station_id"), F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("value"),
    )


def p_snation(spark, sf_dir) -> DataFrame:
    return daily_mean(snation_rows(spark, sf_dir))


def _order_rows(spark, sf_dir, key: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        _text(key).alias("station_id"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("value"),
    )


def p_onation(spark, sf_dir) -> DataFrame:
    return daily_mean(_order_rows(spark, sf_dir, "c_nationkey"))


def p_segment(spark, sf_dir) -> DataFrame:
    return daily_mean(_order_rows(spark, sf_dir, "c_mktsegment"))


def p_supp(spark, sf_dir) -> DataFrame:
    return daily_mean(table(spark, sf_dir, "lineitem").select(
        _text("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("value"),
    ))


def described(spark, sf_dir) -> DataFrame:
    """Order rows in house format: station = nation, texts from customer and order, position by key.

    Some texts and positions are missing, and a station has many spellings.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _text("c_nationkey").alias("station_id"), F.to_date("o_orderdate").alias("date"),
            F.col("n_name").alias("station_name"),
            F.when(key % 5 != 0, F.col("c_mktsegment")).alias("station_env"),
            F.col("o_orderpriority").alias("station_influence"),
            F.col("o_totalprice").alias("value"),
            F.when(key % 3 != 0, (key * 17 % 170 - 85).cast("double") + 0.5).alias("lat"),
            F.when(key % 3 != 0, (key * 37 % 360 - 180).cast("double") + 0.5).alias("lon"),
        )
    )


def spots(spark, sf_dir) -> DataFrame:
    """Customers as stations with a position derived from their key."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _text("c_custkey").alias("station_id"), F.col("c_name").alias("station_name"),
        ((k * 37) % 360 - 180).cast("double").alias("lon"), ((k * 17) % 170 - 85).cast("double").alias("lat"),
    )


def first_id(m: DataFrame) -> str:
    """The treated unit of a sample panel: its smallest id."""
    return m.agg(F.min("station_id")).first()[0]


def _sql_panel(name: str, key: str, date: str, value: str, source: str) -> str:
    return (
        f"{name} AS (SELECT CAST({key} AS VARCHAR) AS station_id, CAST({date} AS DATE) AS date, "
        f"avg({value}) AS value FROM {source} GROUP BY 1, 2)"
    )


_ORDERS = "orders JOIN customer ON o_custkey = c_custkey"
SQL = {
    "p_user": _sql_panel("p_user", "user_id", "ts", "value", "events"),
    "p_type": _sql_panel("p_type", "event_type", "ts", "value", "events"),
    "p_snation": _sql_panel("p_snation", "s_nationkey", "l_shipdate", "l_extendedprice",
                            "lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "p_onation": _sql_panel("p_onation", "c_nationkey", "o_orderdate", "o_totalprice", _ORDERS),
    "p_segment": _sql_panel("p_segment", "c_mktsegment", "o_orderdate", "o_totalprice", _ORDERS),
    "p_supp": _sql_panel("p_supp", "l_suppkey", "l_shipdate", "l_extendedprice", "lineitem"),
    "described": """described AS (
        SELECT CAST(c_nationkey AS VARCHAR) AS station_id, CAST(o_orderdate AS DATE) AS date,
               n_name AS station_name,
               CASE WHEN o_orderkey % 5 <> 0 THEN c_mktsegment END AS station_env,
               o_orderpriority AS station_influence, o_totalprice AS value,
               CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey * 17 % 170 - 85 AS DOUBLE) + 0.5 END AS lat,
               CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey * 37 % 360 - 180 AS DOUBLE) + 0.5 END AS lon
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "spots": """spots AS (
        SELECT CAST(c_custkey AS VARCHAR) AS station_id, c_name AS station_name,
               CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 17 % 170 - 85 AS DOUBLE) AS lat
        FROM customer)""",
}


def with_sql(*names: str, more: str = "") -> str:
    """``WITH`` clause for the named panels, plus further tables."""
    parts = [SQL[n] for n in names] + ([more] if more else [])
    return "WITH " + ", ".join(parts) + " "
