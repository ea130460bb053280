"""Sources, sinks, projections and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcf.operators import clean, spatial, zones
from panelcf.operators.describe import monthly_mean
from panelcf.plans.zone_tables import build_zone_tables, clean_zone_table
from panelcf.registry.book import query, rounded
from panelcf.registry.panels import (
    START, WINDOW, described, first_id, p_onation, p_segment, p_snation, p_user, spots, table, user_rows, with_sql,
)
from panelcf.session import shared_dir
from panelcf.sources import features, tables, upsert

# --- the tables as zone files ------------------------------------------------

#: Areas in a collection document: some 7 MB, which one task reads.
DOCUMENT_AREAS = 20_000


def area_rows(spark, sf_dir) -> DataFrame:
    """One area per customer with orders: zone = nation, dates from its orders."""
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi")
    )
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    return (
        first.join(customer, F.col("o_custkey") == k)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("k"), F.col("n_name").alias("zone"), (F.col("c_nationkey") + 1000).alias("siren"),
            F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
            F.col("lo").cast("string").alias("lo"),
            F.when(k % 7 == 0, F.lit("2999-12-31")).when(k % 7 == 1, F.lit("unknown"))
            .when(k % 7 != 2, F.col("hi").cast("string")).alias("hi"),
            F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment")).alias("rule"),
        )
    )


def feature_lines(spark, sf_dir) -> DataFrame:
    """The areas as JSON features; the publisher's name also hides in the properties."""
    properties = F.struct(
        F.concat(F.lit("A"), F.col("k").cast("string")).alias("id"), F.col("lo").alias("date_debut"),
        F.col("hi").alias("date_fin"), F.col("rule").alias("vp_critair"), F.lit("wrong").alias("publisher_nom"),
        F.col("name").alias("Name"), F.col("segment").alias("NAME"),
    )
    publisher = F.struct(
        F.col("zone").alias("zfe_id"), F.col("zone").alias("nom"), F.col("siren").alias("siren"),
    )
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col("k").cast("double"), F.lit(0.5)).alias("coordinates"))
    feature = F.struct(properties.alias("properties"), publisher.alias("publisher"), geometry.alias("geometry"))
    return area_rows(spark, sf_dir).select(F.to_json(feature).alias("value"))


AREAS_SQL = """areas AS (
    SELECT c_custkey AS k, n_name AS zone, c_nationkey + 1000 AS siren, c_name AS name, c_mktsegment AS segment,
           CAST(min(o_orderdate) AS DATE) AS lo,
           CASE WHEN c_custkey % 7 > 2 THEN CAST(max(o_orderdate) AS DATE) END AS hi,
           CASE WHEN c_nationkey % 4 <> 0 THEN c_mktsegment END AS rule
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY c_custkey, n_name, c_nationkey, c_name, c_mktsegment)"""
META_SQL = """meta AS (
    SELECT zone AS publisher_zfe_id, CAST(siren AS BIGINT) AS publisher_siren, zone AS publisher_nom,
           min(lo) AS first_date_debut, max(lo) AS last_date_debut, min(hi) AS first_date_fin,
           count(DISTINCT k) AS n_aires, bool_or(rule IS NOT NULL) AS has_vp_restriction
    FROM areas GROUP BY 1, 2, 3)"""
IDS_SQL = """ids AS (
    SELECT CAST(n_nationkey + 1000 AS BIGINT) AS siren, n_name AS code, r_name AS epci_principal
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)"""


def zone_ids(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.filter("n_nationkey % 2 = 0").join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        (F.col("n_nationkey") + 1000).cast("bigint").alias("siren"), F.col("n_name").alias("code"),
        F.col("r_name").alias("epci_principal"),
    )


def flat_areas(spark, sf_dir) -> DataFrame:
    docs = feature_lines(spark, sf_dir).select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), "value", F.lit("]}")).alias("doc")
    )
    return features.flatten_features(features.parse_features(docs, "doc"), list(clean.AREA_COLUMNS))


def area_meta(spark, sf_dir) -> DataFrame:
    return zones.zone_meta(clean_zone_table(flat_areas(spark, sf_dir)))


def zone_documents(spark, sf_dir) -> DataFrame:
    """For each zone the number of its documents: with the customers dealt over them, each has about DOCUMENT_AREAS areas at most."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    named = nation.groupBy("n_nationkey", F.col("n_name").alias("of")).agg(F.count(F.lit(1)).alias("times"))
    return (
        customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
        .join(named, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("of").agg(F.ceil(F.sum(F.col("n") * F.col("times")) / DOCUMENT_AREAS).alias("documents"))
    )


@query("s1_read_features", with_sql(more=AREAS_SQL) + """
    SELECT zone, 'A' || k AS id, k AS x FROM areas""")
def s1(spark, sf_dir):
    path = shared_dir(spark, "features")
    feature_lines(spark, sf_dir).write.text(path)
    rows = features.read_features(spark, path, lines=True)
    return rows.select(
        F.element_at("publisher", F.lit("zfe_id")).alias("zone"), F.element_at("properties", F.lit("id")).alias("id"),
        F.get_json_object("geometry", "$.coordinates[0]").cast("double").cast("bigint").alias("x"),
    )


@query("s1_read_collection", with_sql(more=AREAS_SQL) + """
    SELECT zone, 'A' || k AS id, k AS x FROM areas""")
def s1_collection(spark, sf_dir):
    """The standard form: a file is one document, here of one zone. A large zone has several, since a document is read in one task."""
    path = shared_dir(spark, "collections")
    zoned = feature_lines(spark, sf_dir).select(F.get_json_object("value", "$.publisher.zfe_id").alias("z"), "value")
    zoned = zoned.join(F.broadcast(zone_documents(spark, sf_dir)), zoned["z"].eqNullSafe(F.col("of")), "left")
    part = F.pmod(F.xxhash64("value"), F.coalesce("documents", F.lit(1))).alias("part")
    docs = zoned.select("z", part, "value").groupBy("z", "part").agg(F.concat(
        F.lit('{"type": "FeatureCollection",\n"features": ['), F.array_join(F.collect_list("value"), ",\n"), F.lit("]}")).alias("value"))
    docs.write.partitionBy("z", "part").text(path)
    rows = features.read_features(spark, path)
    return rows.select(
        F.element_at("publisher", F.lit("zfe_id")).alias("zone"), F.element_at("properties", F.lit("id")).alias("id"),
        F.get_json_object("geometry", "$.coordinates[0]").cast("double").cast("bigint").alias("x"),
    )


@query("s2_flatten_features", with_sql(more=AREAS_SQL) + """
    SELECT 'A' || k AS id, zone AS publisher_nom, CAST(siren AS VARCHAR) AS publisher_siren,
           zone AS publisher_zfe_id, name AS upper_name, segment AS lower_name, CAST(NULL AS VARCHAR) AS ref
    FROM areas""")
def s2(spark, sf_dir):
    rows = features.parse_features(feature_lines(spark, sf_dir).select(
        F.concat(F.lit('{"features":['), "value", F.lit("]}")).alias("doc")), "doc")
    keys = ["id", "publisher_nom", "publisher_siren", "publisher_zfe_id", "ref"]
    attr = features.attributes()
    flat = features.flatten_features(rows, keys)
    cased = rows.select(attr.alias("a")).select(
        F.col("a")["id"].alias("id"), F.col("a")["Name"].alias("upper_name"), F.col("a")["NAME"].alias("lower_name"))
    return flat.join(cased, "id")


@query("s2_attribute_keys", with_sql(more=AREAS_SQL) + """
    SELECT DISTINCT unnest(['Name', 'NAME', 'date_debut', 'id', 'publisher_nom', 'publisher_siren', 'publisher_zfe_id']
        || CASE WHEN k % 7 <> 2 THEN ['date_fin'] ELSE [] END
        || CASE WHEN rule IS NOT NULL THEN ['vp_critair'] ELSE [] END) AS key FROM areas""")
def s2_keys(spark, sf_dir):
    docs = feature_lines(spark, sf_dir).select(F.concat(F.lit('{"features":['), "value", F.lit("]}")).alias("doc"))
    return features.attribute_keys(features.parse_features(docs, "doc"))


@query("s3_read_table", """
    SELECT s_suppkey AS id, s_name || '; "' || s_nationkey || '"' AS label,
           CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS balance FROM supplier""")
def s3(spark, sf_dir):
    path = shared_dir(spark, "table")
    out = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat("s_name", F.lit('; "'), F.col("s_nationkey").cast("string"), F.lit('"')).alias("label"),
        F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal").cast("string")).otherwise(F.lit("NaN")).alias("balance"),
    )
    out.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    back = tables.read_table(spark, path, ";")
    return back.select(F.col("id").cast("bigint").alias("id"), "label", F.col("balance").cast("double").alias("balance"))


@query("s4_read_panel", with_sql("p_user") + """
    SELECT station_id, date, round(value + 3e-9, 6) AS value FROM p_user""")
def s4(spark, sf_dir):
    path = shared_dir(spark, "panel")
    tables.write_panel(p_user(spark, sf_dir), path)
    return rounded(tables.read_panel(spark, path))


@query("s5_write_table", with_sql("p_onation") + """
    SELECT station_id, CAST(count(*) AS BIGINT) AS n, min(date) AS first_date FROM p_onation GROUP BY 1""")
def s5(spark, sf_dir):
    path = shared_dir(spark, "written")
    counted = p_onation(spark, sf_dir).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))
    tables.write_table(counted, path)
    return spark.read.parquet(path)


KEEP_FIRST_SQL = """
    WITH r AS (SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS date, event_id, value,
                      CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS source FROM events),
         k AS (SELECT *, row_number() OVER (PARTITION BY station_id, date ORDER BY source, event_id) AS rn FROM r)
    SELECT station_id, date, event_id, value, CASE WHEN source = 0 THEN 'base' ELSE 'new' END AS origin
    FROM k WHERE rn = 1"""


def base_and_batch(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("station_id"), F.to_date("ts").alias("date"), "event_id", "value")
    return rows.filter("event_id % 2 = 0").withColumn("origin", F.lit("base")), rows.withColumn("origin", F.lit("new"))


@query("s6_upsert_keep_first", KEEP_FIRST_SQL)
def s6(spark, sf_dir):
    base, batch = base_and_batch(spark, sf_dir)
    return upsert.upsert_keep_first(base, batch, ["station_id", "date"], ["event_id"])


@query("s6_upsert_stored_panel", KEEP_FIRST_SQL)
def s6_stored(spark, sf_dir):
    path = shared_dir(spark, "panel")
    base, batch = base_and_batch(spark, sf_dir)
    for rows in (base, batch, batch):  # created, added to, and left as it is
        upsert.upsert_panel(spark, path, rows, ["event_id"])
    return spark.read.parquet(path).drop("year")


@query("s7_build_zone_tables", with_sql(more=", ".join([AREAS_SQL, META_SQL, IDS_SQL])) + """
    SELECT meta.*, siren, code, epci_principal FROM meta LEFT JOIN ids ON publisher_siren = siren""")
def s7(spark, sf_dir):
    path = shared_dir(spark, "zones")
    feature_lines(spark, sf_dir).write.text(f"{path}/features")
    zone_ids(spark, sf_dir).write.option("header", True).option("sep", ";").csv(f"{path}/ids")
    built = build_zone_tables(spark, f"{path}/features", None, f"{path}/ids", f"{path}/out", lines=True)
    return spark.read.schema(built.meta.schema).parquet(f"{path}/out/meta")


# --- projections and filters -------------------------------------------------


def raw_export(spark, sf_dir) -> DataFrame:
    """Events in the layout of a network export (all columns as text)."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy/MM/dd HH:mm").alias("﻿Date de début"),
        F.lit("NO2").alias("Polluant"),
        F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")).alias("code site"),
        F.concat(F.lit("Station "), F.col("user_id").cast("string")).alias("nom site"),
        F.col("event_type").alias("type d'implantation"),
        F.when(e % 2 == 0, F.lit("Fond")).otherwise(F.lit("Trafic")).alias("type d'influence"),
        F.when(e % 11 != 0, F.col("value").cast("string")).otherwise(F.lit("NaN")).alias("valeur"),
        ((e % 90).cast("double")).cast("string").alias("Latitude"),
        ((e % 180).cast("double")).cast("string").alias("Longitude"),
    )


@query("p1_clean_export", """
    SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS station_id, 'Station ' || user_id AS station_name,
           event_type AS station_env, CASE WHEN event_id % 2 = 0 THEN 'Fond' ELSE 'Trafic' END AS station_influence,
           CASE WHEN event_id % 11 <> 0 THEN value END AS value, CAST(event_id % 90 AS DOUBLE) AS lat,
           CAST(event_id % 180 AS DOUBLE) AS lon FROM events""")
def p1(spark, sf_dir):
    return clean.clean_export(raw_export(spark, sf_dir))


@query("p2_find_column", "SELECT strftime(ts, '%Y/%m/%d %H:%M') AS day FROM events")
def p2(spark, sf_dir):
    raw = raw_export(spark, sf_dir)
    return raw.select(F.col(f"`{clean.find_column(raw, 'Date de début')}`").alias("day"))


@query("p3_require_single", "SELECT CAST(user_id AS VARCHAR) AS station_id, count(*) AS n FROM events GROUP BY 1")
def p3(spark, sf_dir):
    checked = clean.require_single(raw_export(spark, sf_dir))
    return checked.groupBy(F.trim("code site").alias("station_id")).agg(F.count("Polluant").alias("n"))


@query("p3b_filter_pollutant", "SELECT event_id, value FROM events WHERE event_type = 'click'")
def p3b(spark, sf_dir):
    return clean.filter_pollutant(table(spark, sf_dir, "events"), "event_type", "click").select("event_id", "value")


_KEEP_NULL = [c for c in clean.AREA_COLUMNS if c not in (
    "publisher_zfe_id", "publisher_nom", "publisher_siren", "id", "date_debut", "date_fin", "vp_critair")]


@query("p4_project_keep", with_sql(more=AREAS_SQL) + f"""
    SELECT zone AS publisher_zfe_id, zone AS publisher_nom, CAST(siren AS VARCHAR) AS publisher_siren, 'A' || k AS id,
           CAST(lo AS VARCHAR) AS date_debut,
           CASE WHEN k % 7 = 0 THEN '2999-12-31' WHEN k % 7 = 1 THEN 'unknown' ELSE CAST(hi AS VARCHAR) END AS date_fin,
           rule AS vp_critair, {", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in _KEEP_NULL)}
    FROM areas""")
def p4(spark, sf_dir):
    return clean.project_keep(flat_areas(spark, sf_dir), clean.AREA_COLUMNS)


@query("p5_parse_dates_lenient", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 3, 4) THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def p5(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    texts = table(spark, sf_dir, "orders").select("o_orderkey", (
        F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 5 == 1, F.lit("not a date"))
        .when(k % 5 == 2, F.lit("2999-12-31")).when(k % 5 == 3, F.date_format(d, "yyyy/MM/dd"))
        .otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))).alias("day"))
    return clean.parse_dates_lenient(texts, ["day"])


@query("p6_typed_ids", with_sql("spots") + "SELECT station_id, lat, lon FROM spots")
def p6(spark, sf_dir):
    texts = spots(spark, sf_dir).select(
        F.concat(F.lit("  "), "station_id", F.lit(" ")).alias("station_id"),
        F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"))
    return texts.select(
        clean.trimmed_id(F.col("station_id")).alias("station_id"),
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


@query("p7_with_zone", with_sql("p_onation") + "SELECT station_id, date, 'Z1' AS zone FROM p_onation")
def p7(spark, sf_dir):
    return clean.with_zone(p_onation(spark, sf_dir).select("station_id", "date"), "Z1")


@query("p8_find_station", """
    SELECT CAST(c_custkey AS VARCHAR) AS station_id, c_name AS station_name FROM customer
    WHERE contains(lower(c_name), 'customer#0000000') ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 1""")
def p8(spark, sf_dir):
    return clean.find_station(spots(spark, sf_dir), "no such name", "CUSTOMER#0000000")


@query("p9_keep_ids", with_sql("p_user") + """
    SELECT station_id, date FROM p_user
    WHERE station_id IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error' AND value > 40)""")
def p9(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").filter("event_type = 'error' AND value > 40").select(
        F.col("user_id").cast("string").alias("station_id"))
    return clean.keep_ids(p_user(spark, sf_dir), wanted).select("station_id", "date")


@query("p10_tag_period", with_sql("p_onation") + """
    SELECT station_id, date, date < DATE '1999-01-01' AS is_pre, date >= DATE '1999-01-01' AS is_post,
           date >= DATE '1999-01-01' AND NOT date BETWEEN DATE '2000-03-01' AND DATE '2000-06-30' AS is_post_ex
    FROM p_onation""")
def p10(spark, sf_dir):
    return clean.tag_period(p_onation(spark, sf_dir), START, WINDOW).drop("value")


@query("p11_clip_dates", with_sql("p_onation") + """
    SELECT station_id, date FROM p_onation WHERE date BETWEEN DATE '2000-03-01' AND DATE '2000-06-30'""")
def p11(spark, sf_dir):
    return clean.clip_dates(p_onation(spark, sf_dir), *WINDOW).select("station_id", "date")


@query("p12_treatment_start", with_sql(more=f"{AREAS_SQL}, {META_SQL}") + """
    SELECT publisher_zfe_id, CAST(date_trunc('month', min(first_date_debut)) AS DATE) AS start FROM meta GROUP BY 1""")
def p12(spark, sf_dir):
    return zones.treatment_start(area_meta(spark, sf_dir), grain="month")


@query("p13_stations", with_sql("described") + """
    SELECT station_id, min({'a': station_name, 'b': station_influence}).b AS station_influence,
           count(DISTINCT {'a': station_name, 'b': station_influence}) AS n_rows FROM described GROUP BY 1""")
def p13(spark, sf_dir):
    m, columns = described(spark, sf_dir), ["station_name", "station_influence"]
    one = clean.stations(m, columns, one_per_id=True).select("station_id", "station_influence")
    return one.join(clean.stations(m, columns).groupBy("station_id").agg(F.count(F.lit(1)).alias("n_rows")), "station_id")


@query("p14_complete_dates", with_sql("p_segment") + """
    SELECT station_id, date, round(value + 3e-7, 4) AS value FROM p_segment WHERE date IN (
        SELECT date FROM p_segment GROUP BY date
        HAVING count(value) = (SELECT count(DISTINCT station_id) FROM p_segment))""")
def p14(spark, sf_dir):
    return rounded(clean.complete_dates(p_segment(spark, sf_dir)), 4)


@query("p15_drop_empty_series", with_sql("p_user") + """
    SELECT station_id, date FROM p_user WHERE CAST(station_id AS BIGINT) % 10 <> 3""")
def p15(spark, sf_dir):
    holed = p_user(spark, sf_dir).withColumn("value", F.when(F.col("station_id").cast("bigint") % 10 != 3, F.col("value")))
    return clean.drop_empty_series(holed).select("station_id", "date")


@query("g1_station_map_table", with_sql("spots") + """
    SELECT station_id, lat, lon, CAST(station_id AS BIGINT) IN (3, 11) AS is_treated,
           round(6378137.0 * radians(lon) + 3e-6, 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) + 3e-6, 3) AS y
    FROM spots WHERE CAST(station_id AS BIGINT) % 9 <> 0""")
def g1(spark, sf_dir):
    k = F.col("station_id").cast("bigint")
    placed = spots(spark, sf_dir).withColumn("lat", F.when(k % 9 != 0, F.col("lat"))).drop("station_name")
    return rounded(spatial.station_map_table(placed, ["3", "11"]), 3)


# --- joins -------------------------------------------------------------------


@query("j1_enrich_zones", with_sql(more=", ".join([AREAS_SQL, META_SQL, IDS_SQL])) + """
    SELECT publisher_zfe_id, n_aires, siren, code, epci_principal FROM meta LEFT JOIN ids ON publisher_siren = siren""")
def j1(spark, sf_dir):
    return zones.enrich_zones(area_meta(spark, sf_dir), zone_ids(spark, sf_dir)).select(
        "publisher_zfe_id", "n_aires", "siren", "code", "epci_principal")


def zone_features(spark, sf_dir) -> DataFrame:
    """Per nation two polygons: a square with a square hole, and a triangle that overlaps it."""
    k = F.col("n_nationkey").cast("double")
    x, y = k * 14 - 180, k * 5 - 65

    def ring(*corners):
        return F.array(*[F.array(x + a, y + b) for a, b in corners])

    square = ring((0, 0), (20, 0), (20, 20), (0, 20), (0, 0))
    hole = ring((5, 5), (15, 5), (15, 15), (5, 15), (5, 5))
    triangle = ring((10, 10), (30, 10), (10, 30), (10, 10))
    multi = F.array(F.array(square, hole), F.array(triangle))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), multi.alias("coordinates"))
    return table(spark, sf_dir, "nation").select(
        F.create_map(F.lit("id"), F.col("n_name")).alias("properties"),
        F.create_map(F.lit("zfe_id"), F.col("n_name")).alias("publisher"), F.to_json(geometry).alias("geometry"))


IN_ZONE_SQL = """(
    (dx > 0 AND dx < 20 AND dy > 0 AND dy < 20 AND NOT (dx BETWEEN 5 AND 15 AND dy BETWEEN 5 AND 15))
    OR (dx > 10 AND dy > 10 AND dx + dy < 40))"""


@query("j7_flag_in_zone", with_sql("spots") + f"""
    SELECT station_id, {IN_ZONE_SQL} AS in_zone
    FROM (SELECT station_id, lon - (14 * 12 - 180) AS dx, lat - (5 * 12 - 65) AS dy FROM spots)""")
def j7(spark, sf_dir):
    flagged = spatial.flag_in_zone(spots(spark, sf_dir), zone_features(spark, sf_dir), "NATION_12")
    return flagged.select("station_id", "in_zone")


@query("j7_points_in_zones", with_sql("spots") + f"""
    SELECT DISTINCT lon, lat, n_name AS zone
    FROM (SELECT lon, lat, n_name, lon - (14 * n_nationkey - 180) AS dx, lat - (5 * n_nationkey - 65) AS dy
          FROM spots, nation) WHERE {IN_ZONE_SQL}""")
def j7_all(spark, sf_dir):
    return spatial.points_in_zones(spots(spark, sf_dir), spatial.zone_edges(zone_features(spark, sf_dir)))


@query("j8_donors_outside", with_sql("spots") + f"""
    SELECT CAST(o_custkey AS VARCHAR) AS station_id, o_orderkey FROM orders WHERE CAST(o_custkey AS VARCHAR) IN (
        SELECT station_id FROM (SELECT station_id, lon - (14 * 12 - 180) AS dx, lat - (5 * 12 - 65) AS dy FROM spots)
        WHERE NOT {IN_ZONE_SQL})""")
def j8(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("station_id"), "o_orderkey")
    flagged = spatial.flag_in_zone(spots(spark, sf_dir), zone_features(spark, sf_dir), "NATION_12")
    return zones.donors_outside(orders, flagged)


@query("j9_align_dates", with_sql("p_snation", more="""
    t AS (SELECT min(station_id) AS id FROM p_snation)""") + """
    SELECT date, round(any_value(value) FILTER (station_id = id) + 3e-7, 4) AS treated,
           round(avg(value) FILTER (station_id <> id) + 3e-7, 4) AS donors
    FROM p_snation, t GROUP BY date HAVING count(*) FILTER (station_id = id) > 0 AND count(*) FILTER (station_id <> id) > 0""")
def j9(spark, sf_dir):
    m = p_snation(spark, sf_dir)
    own = F.col("station_id") == first_id(m)
    treated = m.filter(own).select("date", F.col("value").alias("treated"))
    donors = m.filter(~own).groupBy("date").agg(F.avg("value").alias("donors"))
    return rounded(clean.align_dates(donors, treated), 4)


@query("j10_attach_meta", with_sql("p_onation", "described") + """
    SELECT station_id, date, station_name FROM
        (SELECT DISTINCT station_id, CAST(date_trunc('month', date) AS DATE) AS date FROM p_onation)
        LEFT JOIN (SELECT DISTINCT station_id, station_name FROM described) USING (station_id)""")
def j10(spark, sf_dir):
    meta = clean.stations(described(spark, sf_dir), ["station_name"])
    return zones.attach_meta(monthly_mean(p_onation(spark, sf_dir)).drop("value"), meta)


# --- sorts and set operations ------------------------------------------------


@query("o1_multi_key_sort", with_sql("p_onation") + "SELECT station_id, date, round(value + 3e-7, 4) AS value FROM p_onation")
def o1(spark, sf_dir):
    return rounded(p_onation(spark, sf_dir), 4).orderBy("station_id", F.desc("date"))


@query("o2_top_rows", """
    SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS date, value FROM events
    ORDER BY value DESC, 1, 2 LIMIT 20""")
def o2(spark, sf_dir):
    return user_rows(spark, sf_dir).orderBy(F.desc("value"), "station_id", "date").limit(20)


@query("o3_union_panels", with_sql("p_onation", "p_segment") + """
    SELECT station_id, date, 'N' AS zone FROM p_onation UNION ALL SELECT station_id, date, NULL AS zone FROM p_segment""")
def o3(spark, sf_dir):
    left = clean.with_zone(p_onation(spark, sf_dir), "N")
    return clean.union_panels(left, p_segment(spark, sf_dir)).select("station_id", "date", "zone")


@query("o4_first_per_key", with_sql("described") + """
    SELECT station_id, station_env, count(*) AS n_days, min(first_day) AS first_day FROM (
        SELECT station_id, date, min(date) AS first_day,
               min({'p': station_influence, 'e': coalesce(station_env, '')}).e AS station_env
        FROM described GROUP BY 1, 2) GROUP BY 1, 2""")
def o4(spark, sf_dir):
    m = described(spark, sf_dir).select("station_id", "date", "station_influence", F.coalesce("station_env", F.lit("")).alias("station_env"))
    first = upsert.first_per_key(m, ["station_id", "date"], ["station_influence"])
    return first.groupBy("station_id", "station_env").agg(F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_day"))


@query("o5_common_dates", with_sql("p_snation", more="t AS (SELECT min(station_id) AS id FROM p_snation)") + """
    SELECT date FROM p_snation, t WHERE station_id = id INTERSECT SELECT date FROM p_snation, t WHERE station_id <> id""")
def o5(spark, sf_dir):
    m = p_snation(spark, sf_dir)
    own = F.col("station_id") == first_id(m)
    return clean.common_dates(m.filter(own), m.filter(~own))
