"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import joins as op
from fieldloom.operators import polygons as pg
from fieldloom.operators import spatial as sp
from fieldloom.plans.filters import HAVERSINE_SQL
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with, text_ts

AB = HAVERSINE_SQL.format(lon1="a.lon", lat1="a.lat", lon2="b.lon", lat2="b.lat")


@query("join_station", sql_with("stations", "SELECT event_id, station, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, value FROM events JOIN stations ON user_id = station WHERE lat > -60"))
def _(t):
    sites = t.stations.where("lat > -60")
    return op.join_lookup(t.observations, sites, "station").select("event_id", "station", "lon", "lat", "value")


@query("join_species_name", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') = c_name")
def _(t):
    named = t.orders.withColumn("species_name", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    return op.join_lookup(named, t.customer, F.col("species_name") == F.col("c_name")).select("o_orderkey", "c_mktsegment")


@query("join_point_bbox", sql_with("points boxes", "SELECT id, box FROM points JOIN boxes ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat"))
def _(t):
    return sp.join_point_bbox(t.points, t.boxes, size=36.0).select("id", "box")


@query("join_bbox_overlap", sql_with("points", """, b AS (SELECT id, lon AS min_lon, lat AS min_lat, lon + 1 + id % 5 AS max_lon, lat + 1 + id % 3 AS max_lat FROM points)
    SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON x.id <> y.id AND x.min_lon <= y.max_lon AND y.min_lon <= x.max_lon
      AND x.min_lat <= y.max_lat AND y.min_lat <= x.max_lat"""))
def _(t):
    k = F.col("id")
    boxes = t.points.select(
        "id", F.col("lon").alias("min_lon"), F.col("lat").alias("min_lat"),
        (F.col("lon") + 1 + k % 5).alias("max_lon"), (F.col("lat") + 1 + k % 3).alias("max_lat"),
    )
    return sp.join_bbox_overlap(boxes, "id", 6.0)


@query("join_point_polygon", sql_with("points boxes", """, r AS (SELECT box, unnest([
        [min_lon, min_lat, max_lon - 20, min_lat + 5], [max_lon - 20, min_lat + 5, max_lon, max_lat], [max_lon, max_lat, min_lon + 30, max_lat - 8],
        [min_lon + 30, max_lat - 8, min_lon, min_lat]]) AS e FROM boxes),
    hits AS (SELECT id, box, count(*) FILTER ((e[2] > lat) <> (e[4] > lat) AND lon < (e[3] - e[1]) * (lat - e[2]) / nullif(e[4] - e[2], 0) + e[1]) AS c
      FROM points CROSS JOIN r GROUP BY 1, 2)
    SELECT p.id, h.box FROM points p LEFT JOIN (SELECT * FROM hits WHERE c % 2 = 1) h ON p.id = h.id"""))
def _(t):
    w, s, e, n = F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")
    polygons = t.boxes.select("box", sp.ring_of([(w, s), (e - 20, s + 5), (e, n), (w + 30, n - 8)]).alias("ring"))
    return sp.join_point_polygon(t.points, polygons, how="left", size=36.0).select("id", "box")


#: regions: a frame of 60 x 28 degrees with a slanted hole; patches: a quadrilateral at each point; a patch's first vertex lies on no region's edge
POLYGONS_SQL = """, g AS (SELECT box AS id, unnest([[0, 3.1, 2.3, 63.2, 3.7], [0, 63.2, 3.7, 61.9, 31.3], [0, 61.9, 31.3, 4.3, 30.1], [0, 4.3, 30.1, 3.1, 2.3],
        [1, 20.3, 10.7, 41.1, 12.9], [1, 41.1, 12.9, 33.7, 24.1], [1, 33.7, 24.1, 20.3, 10.7]]) AS e, min_lon AS w, min_lat AS s FROM boxes),
    ra AS (SELECT id, CAST(e[1] AS INT) AS ring, CAST(w AS DOUBLE) + CAST(e[2] AS DOUBLE) AS x1, CAST(s AS DOUBLE) + CAST(e[3] AS DOUBLE) AS y1,
      CAST(w AS DOUBLE) + CAST(e[4] AS DOUBLE) AS x2, CAST(s AS DOUBLE) + CAST(e[5] AS DOUBLE) AS y2 FROM g),
    h AS (SELECT id, unnest([[0.013, 0.017, 1, 0.3], [1, 0.3, 0.8, 0.9], [0.8, 0.9, 0.2, 1.1], [0.2, 1.1, 0.013, 0.017]]) AS e, lon, lat, CAST(1 + id % 7 AS DOUBLE) AS z FROM points),
    rb AS (SELECT id, lon + z * CAST(e[1] AS DOUBLE) AS x1, lat + z * CAST(e[2] AS DOUBLE) AS y1, lon + z * CAST(e[3] AS DOUBLE) AS x2, lat + z * CAST(e[4] AS DOUBLE) AS y2 FROM h),
    va AS (SELECT id, ring, arg_min(x1, x1) AS x, arg_min(y1, x1) AS y FROM ra GROUP BY 1, 2), vb AS (SELECT id, arg_min(x1, x1) AS x, arg_min(y1, x1) AS y FROM rb GROUP BY 1),
    sides AS (SELECT ra.id AS a, rb.id AS b, sign((ra.x2 - ra.x1) * (rb.y1 - ra.y1) - (ra.y2 - ra.y1) * (rb.x1 - ra.x1)) * sign((ra.x2 - ra.x1) * (rb.y2 - ra.y1) - (ra.y2 - ra.y1) * (rb.x2 - ra.x1)) AS p,
        sign((rb.x2 - rb.x1) * (ra.y1 - rb.y1) - (rb.y2 - rb.y1) * (ra.x1 - rb.x1)) * sign((rb.x2 - rb.x1) * (ra.y2 - rb.y1) - (rb.y2 - rb.y1) * (ra.x2 - rb.x1)) AS q
      FROM ra JOIN rb ON least(ra.x1, ra.x2) <= greatest(rb.x1, rb.x2) AND least(rb.x1, rb.x2) <= greatest(ra.x1, ra.x2)
        AND least(ra.y1, ra.y2) <= greatest(rb.y1, rb.y2) AND least(rb.y1, rb.y2) <= greatest(ra.y1, ra.y2)),
    touching AS (SELECT DISTINCT a, b FROM sides WHERE p <= 0 AND q <= 0), crossing AS (SELECT DISTINCT a, b FROM sides WHERE p < 0 AND q < 0),
    b_in_a AS (SELECT ra.id AS a, vb.id AS b FROM ra JOIN vb ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1),
    a_in_b AS (SELECT va.id AS a, va.ring, rb.id AS b FROM rb JOIN va ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
    meeting AS (SELECT * FROM touching UNION SELECT * FROM b_in_a UNION SELECT a, b FROM a_in_b WHERE ring = 0),
    holding AS (SELECT * FROM b_in_a EXCEPT SELECT * FROM crossing EXCEPT SELECT a, b FROM a_in_b)"""


def _polygons(t):
    def ring(x, y, z, corners):
        return sp.ring_of([(x + z * F.lit(a), y + z * F.lit(b)) for a, b in corners])

    w, s, one = F.col("min_lon"), F.col("min_lat"), F.lit(1.0)
    outer, hole = [(3.1, 2.3), (63.2, 3.7), (61.9, 31.3), (4.3, 30.1)], [(20.3, 10.7), (41.1, 12.9), (33.7, 24.1)]
    regions = t.boxes.select("box", F.array(ring(w, s, one, outer), ring(w, s, one, hole)).alias("rings"))
    patch = ring(F.col("lon"), F.col("lat"), 1.0 + F.col("id") % 7, [(0.013, 0.017), (1.0, 0.3), (0.8, 0.9), (0.2, 1.1)])
    return regions, t.points.select("id", F.array(patch).alias("rings"))


@query("join_polygon_intersects", sql_with("points boxes", POLYGONS_SQL + " SELECT a AS box, b AS id FROM meeting"))
def _(t):
    regions, patches = _polygons(t)
    return pg.join_polygons(regions, patches, "box", "id", "intersects").select(F.col("a").alias("box"), F.col("b").alias("id"))


@query("join_polygon_contains", sql_with("points boxes", POLYGONS_SQL + " SELECT a AS box, b AS id FROM holding"))
def _(t):
    regions, patches = _polygons(t)
    return pg.join_polygons(regions, patches, "box", "id", "contains").select(F.col("a").alias("box"), F.col("b").alias("id"))


@query("join_polygon_within", sql_with("points boxes", POLYGONS_SQL + " SELECT p.id, a AS box FROM points p LEFT JOIN holding ON p.id = b"))
def _(t):
    regions, patches = _polygons(t)
    return pg.join_polygons(patches, regions, "id", "box", "within", "left").select(F.col("a").alias("id"), F.col("b").alias("box"))


@query("join_distance", sql_with("points", f"SELECT a.id AS a, b.id AS b, round({AB}, 3) AS distance_m FROM points a JOIN points b ON a.id < b.id AND {AB} < 400000"))
def _(t):
    return sp.join_distance(t.points, t.points, 400_000, "id", "id", self_join=True, digits=3)


@query("join_distance_count", sql_with("points stations", f"SELECT a.station, count(b.id) AS near FROM stations a LEFT JOIN points b ON {AB} < 1500000 GROUP BY 1"))
def _(t):
    return sp.count_near(t.stations, t.points, 1_500_000, "station")


@query("join_feature_outer", """WITH a AS (SELECT o_custkey AS entity, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    b AS (SELECT c_custkey AS entity, 1 AS n, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0),
    c AS (SELECT user_id AS entity, count(*) AS n FROM events GROUP BY 1)
    SELECT coalesce(a.entity, b.entity, c.entity) AS entity, a.n, a.total, b.n AS n_profile, b.segment, c.n AS n_activity
    FROM a FULL JOIN b ON a.entity = b.entity FULL JOIN c ON coalesce(a.entity, b.entity) = c.entity""")
def _(t):
    a = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    b = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("entity"), F.lit(1).alias("n"), F.col("c_mktsegment").alias("segment"))
    c = t.events.groupBy(F.col("user_id").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return op.join_feature_outer({"orders": a, "profile": b, "empty": None, "activity": c}, "entity")


ASOF_SQL = """, l AS (SELECT o_orderkey AS label, o_custkey AS entity, o_orderdate + INTERVAL 30 DAY AS at FROM orders),
    p AS (SELECT entity, ts, arg_max(price, seq) AS price FROM features WHERE price IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT entity, ts, arg_max(state, seq) AS state FROM features WHERE state IS NOT NULL GROUP BY 1, 2)
    SELECT l.label, l.entity, p.price, s.state FROM l ASOF LEFT JOIN p ON l.entity = p.entity AND l.at >= p.ts
      ASOF LEFT JOIN s ON l.entity = s.entity AND l.at >= s.ts"""


@query("join_asof", sql_with("features", ASOF_SQL))
def _(t):
    labels = t.orders.select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("label"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("at"),
    )
    out = op.join_asof(labels, t.features, ["entity"], ["price", "state"], feature_seq="seq")
    return out.select("label", "entity", "price", "state")


NEAREST_SQL = """, a AS (SELECT unit, balance AS s FROM treatment WHERE treated = 1), b AS (SELECT unit AS match, balance AS s FROM treatment WHERE treated = 0),
    bs AS (SELECT s, min(match) AS match FROM b GROUP BY 1), sa AS (SELECT DISTINCT s FROM a),
    n AS (SELECT sa.s, arg_min(bs.match, row(abs(bs.s - sa.s), bs.match)) AS match, min(abs(bs.s - sa.s)) AS distance FROM sa CROSS JOIN bs GROUP BY 1)
    SELECT a.unit, n.match, round(n.distance, 6) AS distance FROM a JOIN n ON a.s = n.s"""


@query("join_nearest", sql_with("treatment", NEAREST_SQL))
def _(t):
    rows = t.treatment.select("unit", "treated", F.col("balance").alias("score"))
    treated, control = rows.where("treated = 1"), rows.where("treated = 0").withColumnRenamed("unit", "match")
    out = op.join_nearest(treated, control, "unit", "match", "score")
    return out.withColumn("distance", F.round("distance", 6))


@query("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    linked = t.orders.where("o_orderstatus = 'P'")
    return op.semi_exists(t.customer, linked, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name")


@query("anti_missing", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    linked = t.orders.where("o_orderstatus = 'P'")
    return op.anti_missing(t.customer, linked, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name")


@query("join_optional", """WITH f AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F')
    SELECT c_custkey, o_orderkey, coalesce(n, 0) AS matches FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM f GROUP BY 1) ON c_custkey = k
    LEFT JOIN f ON c_custkey = o_custkey""")
def _(t):
    failed = t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    return op.join_optional(t.customer.select("c_custkey"), failed, "c_custkey", "o_custkey").select("c_custkey", "o_orderkey", "matches")
