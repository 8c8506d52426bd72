"""Scans, page checks, record transforms and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom.plans.aggregates import AQI_SQL
from fieldloom.plans.registry import query
from fieldloom.plans.tables import BASE, sql_with, text_ts
from fieldloom.session import shared_dir
from fieldloom.sources import pages, sinks, transforms
from fieldloom.sources.formats import container_kind, read_table
from fieldloom.sources.paged import land_pages, read_paged, stream_paged
from fieldloom.streaming import flows


def _folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_formats", """SELECT fmt, count(*) AS n, round(sum(s_acctbal), 2) AS total, count(DISTINCT s_nationkey) AS nations
    FROM supplier CROSS JOIN (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS fmt) GROUP BY 1
    UNION ALL SELECT 'geojsonl', count(*), round(sum(c_acctbal), 2), count(DISTINCT c_nationkey) FROM customer""")
def _(t):
    out = None
    for fmt in ("csv", "json", "orc", "parquet"):
        path = _folder(t, f"scan-{fmt}")
        t.supplier.write.format(fmt).option("header", "true").save(path)
        part = read_table(t.spark, fmt, path, BASE["supplier"]).agg(
            F.lit(fmt).alias("fmt"), F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"),
            F.countDistinct("s_nationkey").alias("nations"),
        )
        out = part if out is None else out.unionByName(part)
    path = _folder(t, "scan-geojsonl")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("id", "c_acctbal", "c_nationkey").alias("properties"),
    )
    t.points.select(feature.alias("f")).select("f.*").write.json(path)
    places = read_table(t.spark, "geojsonl", path, "id BIGINT, c_acctbal DOUBLE, c_nationkey INT")
    return out.unionByName(places.where("geometry_type = 'Point'").agg(
        F.lit("geojsonl").alias("fmt"), F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"),
        F.countDistinct("c_nationkey").alias("nations"),
    ))


PAGED_SQL = "SELECT event_id, user_id, event_type, value FROM events WHERE value >= 30.0 AND event_type = 'click'"


def _paged(t, paging, page_size):
    path = _folder(t, f"paged-{paging}")
    land_pages(t.events.select("event_id", "user_id", "event_type", "value"), path, [F.col("event_id")], page_size)
    df = read_paged(t.spark, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE", url=path, paging=paging)
    return df.where("value >= 30.0 AND event_type = 'click'")


@query("scan_paged_rest", PAGED_SQL)
def _(t):
    return _paged(t, "offset", 1000)


@query("scan_paged_page", PAGED_SQL)
def _(t):
    return _paged(t, "page", 100)


@query("scan_paged_cursor", PAGED_SQL)
def _(t):
    return _paged(t, "cursor", 2500)


@query("scan_paged_stream", """SELECT event_id, user_id, event_type, value, CAST(CASE WHEN event_id <= m // 3 THEN 0 WHEN event_id <= 2 * m // 3 THEN 1 ELSE 2 END AS INT) AS landing
    FROM events, (SELECT max(event_id) AS m FROM events)""")
def _(t):
    """The source grows twice between triggers, and each time its last page was not full; every record comes once, in the
    run after its landing."""
    events = t.events.select("event_id", "user_id", "event_type", "value")
    url, name, most = _folder(t, "paged-grows"), f"paged-stream-{uuid.uuid4().hex}", t.events.agg(F.max("event_id").alias("m")).scalar()
    out, schema = None, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE"
    for landing in range(3):
        land_pages(events.where(F.col("event_id") <= F.expr(f"CAST({landing + 1} AS BIGINT)") * most / 3), url, [F.col("event_id")], 700)
        flows.run_to_table(stream_paged(t.spark, schema, url=url).withColumn("landing", F.lit(landing)), name)
    return t.spark.read.schema(schema + ", landing INT").parquet(f"{shared_dir(t.spark)}/{name}")


@query("page_envelope", """SELECT page_id, 'web' AS source_name, '2024-01-01 00:00:00' AS fetched_at, CASE WHEN html LIKE '<%' THEN 'html' ELSE 'text' END AS format,
    octet_length(encode(html)) AS size_bytes, sha256(html) AS checksum FROM pages""")
def _(t):
    fmt = F.when(F.col("html").startswith("<"), "html").otherwise("text")
    out = pages.envelope(t.pages, "html", "web", fmt, F.lit("2024-01-01").cast("timestamp"))
    return out.select("page_id", "source_name", text_ts("fetched_at").alias("fetched_at"), "format", "size_bytes", "checksum")


@query("dedupe_pages", """SELECT min(doc_id) AS doc_id, sha256(text) AS checksum FROM documents WHERE sha256(text) NOT IN
    (SELECT sha256(text) FROM documents WHERE source = 'wiki' OR lang = 'de') GROUP BY 2""")
def _(t):
    docs = t.documents.select("doc_id", "lang", "source", F.sha2("text", 256).alias("checksum"))
    seen = docs.where("source = 'wiki' OR lang = 'de'")
    return pages.dedupe_pages(docs, "doc_id", seen).select("doc_id", "checksum")


def _station_records(t):
    k = F.col("event_id")
    types = F.array(*[F.lit(x) for x in ("TAVG", "TMAX", "TMIN", "PRCP", "AWND", "RHAV", "SLP", "SNOW")])
    records = t.events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.element_at(types, (F.col("user_id") % 8 + 1).cast("int")).alias("datatype"), (F.col("value") * 10).alias("value"),
        F.col("user_id").alias("station"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), (k % 10).cast("string"), F.lit(" ,,W"))).when(k % 3 == 1, "A,,7").alias("attributes"),
    )
    sites = t.stations.where("lat > -60").select(
        "station", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit(None).cast("double").alias("elevation")
    )
    return records, sites


@query("xf_noaa", sql_with("stations", """, r AS (SELECT event_id, ts, ['TAVG', 'TMAX', 'TMIN', 'PRCP', 'AWND', 'RHAV', 'SLP', 'SNOW'][CAST(user_id % 8 + 1 AS INT)] AS datatype,
      value * 10 AS value, user_id AS station, CASE WHEN event_id % 3 = 0 THEN event_id % 10 ELSE 0 END AS flag FROM events)
    SELECT CASE datatype WHEN 'PRCP' THEN 'precipitation' WHEN 'AWND' THEN 'wind_speed' WHEN 'RHAV' THEN 'humidity' WHEN 'SLP' THEN 'pressure' ELSE 'temperature' END AS variable,
      CASE datatype WHEN 'PRCP' THEN 'mm' WHEN 'AWND' THEN 'm/s' WHEN 'RHAV' THEN '%' WHEN 'SLP' THEN 'hPa' ELSE '°C' END AS unit,
      round(CASE WHEN datatype IN ('TAVG', 'TMAX', 'TMIN', 'PRCP') THEN value / 10 ELSE value END, 6) AS value, 'station:' || r.station AS source,
      CAST(lat AS DOUBLE) AS latitude, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, flag AS quality_flag
    FROM r JOIN stations s ON r.station = s.station WHERE datatype <> 'SNOW' AND lat > -60"""))
def _(t):
    out = transforms.station_records(*_station_records(t))
    return out.select(
        "variable", "unit", F.round("value", 6).alias("value"), "source", "latitude", text_ts("ts").alias("ts"),
        F.col("quality_flag").cast("long").alias("quality_flag"),
    )


@query("xf_gbif", """WITH r AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders)
    SELECT k AS "gbifID", CASE WHEN k % 5 = 0 THEN 'Genus ' || k % 50 ELSE 'species ' || k % 100 END AS species_name,
      strftime(CASE k % 4 WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN d + INTERVAL 5 HOUR ELSE d END, '%Y-%m-%d %H:%M:%S') AS observed_at,
      greatest(1, CASE WHEN k % 6 = 0 THEN 1 ELSE k % 6 - 2 END) AS count, CASE WHEN k % 3 = 0 THEN 'human_observation' ELSE 'preserved_specimen' END AS evidence_type,
      round(CAST(greatest(0, least(1, 1 - CASE WHEN k % 13000 > 10000 THEN 0.3 WHEN k % 13000 > 1000 THEN 0.1 ELSE 0 END - least(0.3, k % 8 * 0.05) + CASE WHEN k % 9 = 0 THEN 0.05 ELSE 0 END)) AS DOUBLE), 6) AS confidence
    FROM r WHERE k % 11 <> 0 AND k % 17 <> 0 AND k % 19 <> 0""")
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    date = (
        F.when(k % 19 == 0, "unknown date").when(k % 4 == 0, F.date_format(d, "yyyy")).when(k % 4 == 1, F.date_format(d, "yyyy-MM"))
        .when(k % 4 == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T05:00:00Z"))).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" (about)")))
    )
    records = t.orders.select(
        k.alias("gbifID"), F.when(k % 5 != 0, F.concat(F.lit("species "), (k % 100).cast("string"))).alias("species"),
        F.concat(F.lit("Genus "), (k % 50).cast("string")).alias("scientificName"),
        F.when(k % 11 != 0, (k % 180 - 90).cast("double")).alias("decimalLatitude"), (k % 360 - 180).cast("double").alias("decimalLongitude"),
        F.when(k % 17 != 0, date).alias("eventDate"), F.when(k % 6 != 0, k % 6 - 2).alias("individualCount"),
        F.when(k % 3 != 0, "PRESERVED_SPECIMEN").alias("basisOfRecord"), F.lit("set").alias("datasetKey"),
        F.slice(F.array(*[F.lit(f"issue {i}") for i in range(8)]), F.lit(1), (k % 8).cast("int")).alias("issues"),
        F.when(k % 9 == 0, F.array(F.lit("photo"))).alias("media"), (k % 13000).cast("double").alias("coordinateUncertaintyInMeters"),
    )
    out = transforms.occurrence_records(records)
    return out.select(
        "gbifID", "species_name", text_ts("observed_at").alias("observed_at"), "count", "evidence_type",
        F.round("confidence", 6).alias("confidence"),
    )


@query("xf_openaq", f"""WITH r AS (SELECT event_id, ts, user_id, value, ['pm25', 'pm10', 'o3', 'no2', 'so2', 'co', 'bc'][CAST(event_id % 7 + 1 AS INT)] AS parameter FROM events)
    SELECT event_id AS id, parameter, value, {AQI_SQL} AS aqi, CAST(CASE WHEN event_id % 4 = 0 THEN user_id % 80 ELSE user_id % 90 END AS DOUBLE) AS latitude,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN parameter = 'o3' THEN value END AS ozone, 'air:' || user_id AS source
    FROM r WHERE event_id % 23 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0""")
def _(t):
    k = F.col("event_id")
    names = F.array(*[F.lit(x) for x in ("pm25", "pm10", "o3", "no2", "so2", "co", "bc")])

    def point(lat, lon):
        return F.struct(lat.cast("double").alias("latitude"), lon.cast("double").alias("longitude"))

    u = F.col("user_id")
    records = t.events.select(
        k.alias("id"), F.element_at(names, (k % 7 + 1).cast("int")).alias("parameter"), F.when(k % 31 != 0, F.col("value")).alias("value"),
        F.struct(F.when(k % 29 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("utc")).alias("date"),
        F.when(k % 4 == 0, point(F.when(k % 23 != 0, u % 80), u % 170)).alias("coordinates"),
        F.struct(u.alias("id"), F.when(k % 23 != 0, point(u % 90, u % 170)).alias("coordinates")).alias("location"),
    )
    out = transforms.air_records(records)
    return out.select(
        "id", "parameter", "value", F.col("aqi").cast("long").alias("aqi"), "latitude", text_ts("ts").alias("ts"), "ozone", "source"
    )


@query("xf_era5_grid", sql_with("pixels", """, g AS (SELECT raster_id, band, "row" AS r, col AS c, value FROM pixels)
    SELECT CASE band WHEN 3 THEN 'temperature' ELSE 'pressure' END AS variable, CASE band WHEN 3 THEN '°C' ELSE 'hPa' END AS unit,
      round(CASE band WHEN 3 THEN value - 273.15 ELSE value / 100 END, 4) AS value, CAST(r AS DOUBLE) / 2 AS latitude, CAST(c AS DOUBLE) / 4 AS longitude, g.raster_id AS raster
    FROM g WHERE value <> -9999"""))
def _(t):
    nan = F.when(F.col("value") == -9999, F.lit(float("nan"))).otherwise(F.col("value"))
    lines = t.pixels.groupBy("raster_id", "band", "row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col", nan.alias("v")))), lambda x: x["v"]).alias("line")
    )
    grids = lines.groupBy("raster_id", "band").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("g")).select(
        F.when(F.col("band") == 3, "2m_temperature").otherwise("surface_pressure").alias("variable"), F.col("raster_id").alias("time"),
        F.transform("g", lambda x: x["row"].cast("double") / 2).alias("lats"),
        F.expr("transform(sequence(0, 99), x -> cast(x as double) / 4)").alias("lons"), F.transform("g", lambda x: x["line"]).alias("values"),
    )
    return transforms.grid_records(grids).select("variable", "unit", "value", "latitude", "longitude", F.col("ts").alias("raster"))


@query("xf_stac", """SELECT 'item-' || page_id AS id, CASE WHEN page_id % 3 <> 0 THEN 'scenes' ELSE '' END AS collection, '2024-01-01T00:00:00Z' AS datetime,
    CAST(page_id % 100 AS DOUBLE) AS cloud_cover, url AS data_href, '' AS thumb_href, CAST(page_id % 180 AS DOUBLE) AS west FROM pages""")
def _(t):
    k = F.col("page_id")
    asset = "STRUCT<href: STRING>"
    items = t.pages.select(
        F.concat(F.lit("item-"), k.cast("string")).alias("id"), F.when(k % 3 != 0, "scenes").alias("collection"),
        F.array(*[(k % 180 + i).cast("double") for i in range(4)]).alias("bbox"),
        F.struct(
            F.lit("2024-01-01T00:00:00Z").alias("datetime"), (k % 100).cast("double").alias("eo:cloud_cover"),
            F.lit(None).cast("string").alias("platform"), F.lit(10.0).alias("gsd"),
        ).alias("properties"),
        F.create_map(
            F.lit("data"), F.struct(F.col("url").alias("href")).cast(asset), F.lit("thumb"), F.struct(F.lit(None).cast("string").alias("href")).cast(asset)
        ).alias("assets"),
    )
    out = transforms.stac_items(items)
    return out.select(
        "id", "collection", "datetime", "cloud_cover", F.col("assets")["data"].alias("data_href"),
        F.col("assets")["thumb"].alias("thumb_href"), F.element_at("bbox", 1).alias("west"),
    )


@query("xf_cropscape", """WITH r AS (SELECT p_partkey, p_size AS year, CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE CAST(p_partkey % 45 AS VARCHAR) END AS category, p_partkey % 30 AS code,
      CASE WHEN p_partkey % 9 = 0 THEN -1 ELSE p_retailprice END AS acres, p_partkey % 8 = 0 AS bad FROM part),
    p AS (SELECT p_partkey, year, CASE WHEN bad THEN NULL WHEN category = 'n/a' THEN code ELSE CAST(category AS BIGINT) END AS code, category, acres FROM r WHERE acres > 0),
    t AS (SELECT year, sum(acres) AS total FROM p GROUP BY 1)
    SELECT CAST(p.year AS BIGINT) AS year, CAST(code AS BIGINT) AS crop_code, CASE code WHEN 1 THEN 'Corn' WHEN 2 THEN 'Cotton' WHEN 3 THEN 'Rice' WHEN 4 THEN 'Sorghum' WHEN 5 THEN 'Soybeans' WHEN 6 THEN 'Sunflower'
      WHEN 21 THEN 'Barley' WHEN 23 THEN 'Spring Wheat' WHEN 24 THEN 'Winter Wheat' WHEN 26 THEN 'Double Crop Winter Wheat/Soybeans' WHEN 27 THEN 'Rye' WHEN 28 THEN 'Oats' WHEN 36 THEN 'Alfalfa'
      WHEN 37 THEN 'Other Hay/Non Alfalfa' WHEN 41 THEN 'Sugarbeets' WHEN 42 THEN 'Dry Beans' WHEN 43 THEN 'Potatoes' WHEN 44 THEN 'Other Crops' ELSE category END AS crop_name,
      round(acres, 2) AS acreage, round(acres / total * 100, 2) AS percentage FROM p JOIN t ON p.year = t.year WHERE code IS NOT NULL""")
def _(t):
    k = F.col("p_partkey")
    entries = t.part.select(
        F.col("p_size").cast("long").alias("year"), F.when(k % 4 == 0, "n/a").otherwise((k % 45).cast("string")).alias("category"),
        F.when(k % 8 != 0, (k % 30).cast("string")).alias("cropCode"), F.lit(None).cast("string").alias("cropName"),
        F.when(k % 9 == 0, "-1").otherwise(F.format_number("p_retailprice", 2)).alias("acreage"),
    )
    out = transforms.crop_acreage(entries, ["year"])
    return out.select("year", F.col("crop_code").cast("long").alias("crop_code"), "crop_name", "acreage", "percentage")


def _pages_of_events(t):
    record = F.struct(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 997 != 0, F.col("event_type")).alias("variable"), "value", "ts"
    )
    filled = t.events.groupBy(F.floor(F.col("event_id") / 50).alias("page_id")).agg(F.collect_list(record).alias("records"))
    return filled.withColumn("records", F.when(F.col("page_id") % 41 == 0, F.slice("records", 1, 0)).otherwise(F.col("records")))


VALID_SQL = """WITH p AS (SELECT event_id // 50 AS page_id, count(*) AS n, bool_and(event_id % 997 <> 0) AS complete, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS kept FROM events GROUP BY 1)"""


@query("page_validate", VALID_SQL + " SELECT page_id, complete AND page_id % 41 <> 0 AS accepted FROM p")
def _(t):
    good, bad = pages.validate_pages(_pages_of_events(t), "records", ["id", "variable", "value"])
    return good.select("page_id", F.lit(True).alias("accepted")).unionByName(bad.select("page_id", F.lit(False).alias("accepted")))


@query("ingest_pages", VALID_SQL + """ SELECT page_id, complete AND page_id % 41 <> 0 AS accepted, CASE WHEN page_id % 41 = 0 THEN 0 ELSE n END AS records_in,
    CASE WHEN complete AND page_id % 41 <> 0 THEN CAST(kept AS BIGINT) ELSE 0 END AS records_out FROM p""")
def _(t):
    return pages.page_log(
        _pages_of_events(t), "page_id", "records", ["id", "variable", "value"], lambda df: df.where("value > 20")
    )


@query("ingest_batch", VALID_SQL + """, s AS (SELECT CASE WHEN page_id % 41 = 0 THEN 0 ELSE n END AS n, complete AND page_id % 41 <> 0 AS ok, kept FROM p)
    SELECT 'fetch' AS stage, count(*) AS records FROM s UNION ALL SELECT 'validate', count(*) FILTER (ok) FROM s
    UNION ALL SELECT 'transform', CAST(sum(kept) FILTER (ok) AS BIGINT) FROM s UNION ALL SELECT 'store', CAST(sum(kept) FILTER (ok) AS BIGINT) FROM s""")
def _(t):
    path = _folder(t, "ingest")
    log = pages.ingest_batch(
        _pages_of_events(t), "events", "records", ["id", "variable", "value"], lambda df: df.where("value > 20"),
        store=lambda df: df.write.mode("overwrite").parquet(path),
    )
    return log.select("stage", "records")


@query("binary_magic", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'netcdf3' WHEN 1 THEN 'hdf5' WHEN 2 THEN 'grib' END AS kind FROM documents
    WHERE NOT (doc_id % 5 > 2 AND (text LIKE 'CDF%' OR text LIKE 'GRIB%'))""")
def _(t):
    k = F.col("doc_id") % 5
    body = F.encode("text", "UTF-8")
    payload = (
        F.when(k == 0, F.concat(F.unhex(F.lit("43444601")), body)).when(k == 1, F.concat(F.unhex(F.lit("894844460D0A")), body))
        .when(k == 2, F.concat(F.unhex(F.lit("47524942")), body)).otherwise(body)
    )
    return t.documents.select("doc_id", container_kind(payload).alias("kind"))


@query("src_catalogue", """SELECT name, n FROM (SELECT 'station ' || user_id AS name, count(*) AS n, list_contains(list(DISTINCT event_type), 'purchase') AS has,
      max(ts) >= TIMESTAMP '2024-01-29' AS active FROM events GROUP BY 1) WHERE has AND active AND contains(name, 'station 1')""")
def _(t):
    catalogue = t.events.groupBy("user_id").agg(
        F.collect_set("event_type").alias("domains"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")
    ).select(
        F.concat(F.lit("station "), F.col("user_id").cast("string")).alias("name"), F.lit("readings").alias("description"), "domains", "n",
        F.when(F.col("last") >= F.lit("2024-01-29").cast("timestamp"), "active").otherwise("idle").alias("status"),
    )
    return pages.search_catalogue(catalogue, "purchase", "active", "STATION 1").select("name", "n")


RUNS_SQL = """WITH r AS (SELECT event_type AS source_name, date_trunc('day', ts) AS day, min(ts) AS started_at, count(*) AS total_records,
    CASE WHEN max(value) > 250 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY 1, 2)"""


@query("ingest_run_log", RUNS_SQL + """ SELECT source_name, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, total_records FROM r WHERE status = 'completed' AND source_name = 'click'""")
def _(t):
    runs = t.events.groupBy(F.col("event_type").alias("source_name"), F.date_trunc("day", "ts").alias("day")).agg(
        F.min("ts").alias("started_at"), F.count(F.lit(1)).alias("total_records"),
        F.when(F.max("value") > 250, "failed").otherwise("completed").alias("status"),
    )
    return pages.run_log(runs, "click", "completed").select("source_name", text_ts("started_at").alias("started_at"), "total_records")


@query("upsert", """WITH c AS (SELECT o_custkey + 200 AS k, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS bal, arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS seg FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
    SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NOT NULL THEN bal ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey IS NULL THEN seg ELSE c_mktsegment END AS c_mktsegment
    FROM customer FULL JOIN c ON c_custkey = k""")
def _(t):
    stored = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = t.orders.where("o_custkey % 2 = 0").select(
        (F.col("o_custkey") + 200).alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderstatus").alias("c_mktsegment"),
        "o_orderdate", "o_orderkey",
    )
    return sinks.upsert(stored, changes, ["c_custkey"], ["c_acctbal"], ["o_orderdate", "o_orderkey"])


@query("object_table", """SELECT lang || '/' || source || '/' || d.doc_id AS key, CASE WHEN l.quality = 1 THEN 'checked' ELSE md5(text) END AS data, strftime(TIMESTAMP '2024-01-01', '%Y-%m-%d %H:%M:%S') AS created_at
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'en' AND coalesce(l.toxic, 0) = 0""")
def _(t):
    key = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    first, later = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")

    def objects(df, data, at):
        return df.select(key.alias("key"), data.cast("binary").alias("data"), F.create_map(F.lit("lang"), "lang").alias("metadata"), at.alias("created_at"), at.alias("updated_at"))

    docs, marked = t.documents, t.documents.join(t.labels, "doc_id")
    stored = objects(docs, F.md5("text"), first)
    stored = sinks.put_objects(stored, objects(marked.where("quality = 1"), F.lit("checked"), later))
    stored = sinks.delete_objects(stored, marked.where("toxic = 1").select(key.alias("key")))
    listed = sinks.list_keys(stored, "en/")
    return stored.join(listed, "key").select("key", F.col("data").cast("string").alias("data"), text_ts("created_at").alias("created_at"))


@query("write_partitioned", """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-15' AND TIMESTAMP '1998-02-10' GROUP BY 1""")
def _(t):
    path = _folder(t, "partitioned")
    sinks.write_partitioned(t.orders, path, "o_orderdate", "quarter")
    rows = sinks.read_partitioned(t.spark, path, BASE["orders"], "o_orderdate", "1997-03-15", "1998-02-10", "quarter")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("retention_tiers", """SELECT o_orderkey, datediff('day', o_orderdate, DATE '2001-08-01') AS age_days, CASE WHEN datediff('day', o_orderdate, DATE '2001-08-01') <= 7 THEN 'hot'
      WHEN datediff('day', o_orderdate, DATE '2001-08-01') <= 365 THEN 'warm' ELSE 'cold' END AS tier FROM orders WHERE datediff('day', o_orderdate, DATE '2001-08-01') <= 1825""")
def _(t):
    out = sinks.retention_tiers(t.orders, "o_orderdate", F.lit("2001-08-01").cast("timestamp"), 5 * 365)
    return out.select("o_orderkey", F.col("age_days").cast("long").alias("age_days"), "tier")
