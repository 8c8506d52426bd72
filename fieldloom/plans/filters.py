"""Filters, search and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import filters as op
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with, text_ts

BBOX = (-100.0, -45.0, 60.0, 45.0)

HAVERSINE_SQL = (
    "2 * 6371008.8 * asin(least(sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
    "cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)), 1.0))"
)


@query("filter_bbox", sql_with("points", "SELECT id, lon, lat FROM points WHERE lon BETWEEN -100 AND 60 AND lat BETWEEN -45 AND 45"))
def _(t):
    return op.filter_bbox(t.points, BBOX).select("id", "lon", "lat")


@query("bbox_valid", sql_with("points", """SELECT id AS box, c_acctbal / 50 AS shift,
    (lon + c_acctbal / 50 BETWEEN -180 AND 180 AND lon + 20 + c_acctbal / 50 BETWEEN -180 AND 180
     AND lat BETWEEN -90 AND 90 AND lat + c_acctbal / 100 BETWEEN -90 AND 90 AND c_acctbal >= 0) AS valid FROM points"""))
def _(t):
    shift = F.col("c_acctbal") / 50
    return t.points.select(
        F.col("id").alias("box"), shift.alias("shift"),
        op.bbox_valid(
            F.col("lon") + shift, F.col("lat"), F.col("lon") + 20 + shift, F.col("lat") + F.col("c_acctbal") / 100
        ).alias("valid"),
    )


@query("filter_time", """SELECT event_id, value FROM events
    WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-01-12 18:00:00'""")
def _(t):
    return op.filter_time(t.events, "2024-01-05 06:00:00", "2024-01-12 18:00:00").select("event_id", "value")


@query("filter_attrs", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND value >= 10 AND value <= 40")
def _(t):
    out = op.filter_attrs(t.events, {"event_type": "click", "user_id": None}, {"value": 10}, {"value": 40})
    return out.select("event_id", "event_type", "value")


@query("search_name", """SELECT p_partkey, p_name, p_brand FROM part
    WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')) AND p_type = 'ECONOMY'""")
def _(t):
    out = op.search_name(t.part, "RING", ["p_name", "p_brand"], "ECONOMY", "p_type")
    return out.select("p_partkey", "p_name", "p_brand")


@query("filter_entities", """SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(t):
    wanted = t.customer.where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return op.filter_entities(t.orders, wanted, "o_custkey").select("o_orderkey", "o_custkey")


@query("filter_viewport", sql_with("stations", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
    FROM events JOIN stations ON user_id = station WHERE lon BETWEEN -100 AND 60 AND lat BETWEEN -45 AND 45
    AND event_type <> 'error' ORDER BY events.ts DESC, event_id LIMIT 200"""))
def _(t):
    placed = t.events.withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("ts"))).join(
        t.stations, F.col("user_id") == F.col("station")
    )
    out = op.filter_viewport(op.soft_delete(placed), BBOX, "ts", "event_id", 200)
    return out.select("event_id", text_ts("ts").alias("ts"))


@query("filter_radius", sql_with("points", f"""SELECT id, round(d, 3) AS distance_m FROM (SELECT id,
    {HAVERSINE_SQL.format(lon1='lon', lat1='lat', lon2='10.0', lat2='48.0')} AS d FROM points) WHERE d <= 2500000
    ORDER BY d, id LIMIT 100"""))
def _(t):
    out = op.filter_radius(t.points, 10.0, 48.0, 2_500_000, "id", 100)
    return out.select("id", F.round("distance_m", 3).alias("distance_m"))


@query("soft_delete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    marked = t.orders.withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return op.soft_delete(marked).select("o_orderkey", "o_orderstatus")


@query("paginate", """SELECT event_id, value, (SELECT count(*) FROM events) AS total,
    150 < (SELECT count(*) FROM events) AS has_next FROM events ORDER BY value DESC, event_id LIMIT 50 OFFSET 100""")
def _(t):
    page = op.paginate(t.events.select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 3, 50)
    return page.select("event_id", "value", "total", "has_next")
