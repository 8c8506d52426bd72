"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import geo, scalar, stats
from fieldloom.operators.spatial import covering, ring_of
from fieldloom.plans.aggregates import AQI_SQL, CATEGORY_SQL
from fieldloom.plans.filters import HAVERSINE_SQL
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with, text_ts


@query("fn_aqi", sql_with("air", f"SELECT event_id, parameter, {AQI_SQL} AS aqi FROM (SELECT event_id, parameter, value * 3 AS value FROM air)"))
def _(t):
    return t.air.select("event_id", "parameter", scalar.aqi(F.col("parameter"), F.col("value") * 3).cast("long").alias("aqi"))


@query("fn_aqi_category", f"SELECT event_id, {CATEGORY_SQL} AS category FROM (SELECT event_id, value * 3 AS aqi FROM events)")
def _(t):
    return t.events.select("event_id", scalar.aqi_category(F.col("value") * 3).alias("category"))


@query("fn_severity_rank", """SELECT event_id, CASE WHEN value > 120 THEN 5 WHEN value > 90 THEN 4 WHEN value > 60 THEN 3 WHEN value > 30 THEN 2 WHEN value > 1 THEN 1 ELSE 0 END AS rank,
    CASE user_id % 6 WHEN 5 THEN 0 ELSE user_id % 6 + 1 END AS drought FROM events""")
def _(t):
    v = F.col("value")
    name = F.when(v > 120, "critical").when(v > 90, "high").when(v > 60, "medium").when(v > 30, "low").when(v > 1, "info").otherwise("?")
    drought = F.concat(F.lit("D"), (F.col("user_id") % 6).cast("string"))
    return t.events.select(
        "event_id", scalar.severity_rank(name).cast("long").alias("rank"), scalar.drought_rank(drought).cast("long").alias("drought")
    )


@query("fn_haversine", sql_with("points", f"SELECT id, round({HAVERSINE_SQL.format(lon1='lon', lat1='lat', lon2='c_acctbal / 100', lat2='c_nationkey * 3.0')}, 3) AS metres FROM points"))
def _(t):
    d = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("c_acctbal") / 100, F.col("c_nationkey") * 3.0)
    return t.points.select("id", F.round(d, 3).alias("metres"))


TILE_SQL = """CAST(least(greatest(floor((lon + 180) / 360 * {n}), 0), {n} - 1) AS BIGINT) AS x, CAST(least(greatest(floor((1 - ln(tan(radians(greatest(least(lat, 85.0511287798066), -85.0511287798066)))
    + 1 / cos(radians(greatest(least(lat, 85.0511287798066), -85.0511287798066)))) / pi()) / 2 * {n}), 0), {n} - 1) AS BIGINT) AS y"""


@query("fn_tile", sql_with("points", f""", t AS (SELECT id, {TILE_SQL.format(n=4096)} FROM points)
    SELECT id, '12/' || x || '/' || y AS tile, '9/' || (x // 8) || '/' || (y // 8) AS parent, round(x / 4096 * 360 - 180, 6) AS west,
      round(degrees(atan(sinh(pi() * (1 - 2.0 * (y + 1) / 4096)))), 6) AS south FROM t"""))
def _(t):
    tile = geo.tile_of(F.col("lon"), F.col("lat"), 12)
    west, south, _, _ = geo.tile_bounds(F.col("tile"))
    return t.points.select("id", tile.alias("tile")).select(
        "id", "tile", geo.tile_parent(F.col("tile"), 3).alias("parent"), F.round(west, 6).alias("west"), F.round(south, 6).alias("south")
    )


@query("fn_tile_cover", sql_with("points", f""", a AS (SELECT id, {TILE_SQL.format(n=64)} FROM points),
    b AS (SELECT id, {TILE_SQL.format(n=64)} FROM (SELECT id, least(lon + 7, 180) AS lon, greatest(lat - 5, -90) AS lat FROM points))
    SELECT id, '6/' || i || '/' || j AS tile FROM (SELECT id, i, unnest(range(y0, y1 + 1)) AS j FROM
      (SELECT a.id, unnest(range(a.x, b.x + 1)) AS i, a.y AS y0, b.y AS y1 FROM a JOIN b ON a.id = b.id))"""))
def _(t):
    boxes = t.points.select(
        "id", F.col("lon").alias("min_lon"), F.greatest(F.col("lat") - 5, F.lit(-90.0)).alias("min_lat"),
        F.least(F.col("lon") + 7, F.lit(180.0)).alias("max_lon"), F.col("lat").alias("max_lat"),
    )
    return covering(boxes, "id", 6)


@query("fn_mercator", sql_with("points", """, m AS (SELECT id, radians(lon) * 6378137 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 AS y FROM points WHERE abs(lat) < 85)
    SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(degrees(x / 6378137), 7) AS lon, round(degrees(2 * atan(exp(y / 6378137)) - pi() / 2), 7) AS lat FROM m"""))
def _(t):
    x, y = geo.to_mercator(F.col("lon"), F.col("lat"))
    m = t.points.where(F.abs("lat") < 85).select("id", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_mercator(F.col("x"), F.col("y"))
    return m.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def _triangle(t):
    x, y = F.col("lon"), F.col("lat")
    return t.points.select("id", ring_of([(x, y), (x + 2, y + 1), (x + 1 + F.col("id") % 5, y - 3)]).alias("ring"))


@query("fn_polygon_bbox", sql_with("points", """SELECT id, lon AS min_lon, lat - 3 AS min_lat, greatest(lon + 2, lon + 1 + id % 5) AS max_lon, lat + 1 AS max_lat FROM points"""))
def _(t):
    names = ("min_lon", "min_lat", "max_lon", "max_lat")
    return _triangle(t).select("id", *[c.alias(n) for c, n in zip(geo.ring_bbox(F.col("ring")), names)])


@query("fn_polygon_area", sql_with("points", """, r AS (SELECT id, lon AS x1, lat AS y1, lon + 2 AS x2, lat + 1 AS y2, lon + 1 + id % 5 AS x3, lat - 3 AS y3 FROM points)
    SELECT id, round(abs(radians(x2 - x1) * (sin(radians(y1)) + sin(radians(y2))) + radians(x3 - x2) * (sin(radians(y2)) + sin(radians(y3)))
      + radians(x1 - x3) * (sin(radians(y3)) + sin(radians(y1)))) / 2 * 6371.0088 * 6371.0088, 3) AS area_km2 FROM r"""))
def _(t):
    return _triangle(t).select("id", F.round(geo.ring_area_km2(F.col("ring")), 3).alias("area_km2"))


@query("fn_ndvi", "SELECT p_partkey, round(CASE WHEN p_retailprice + p_size - 900 = 0 THEN 0 ELSE greatest(-1, least(1, (p_retailprice - 900 - p_size) / (p_retailprice - 900 + p_size))) END, 6) AS ndvi FROM part")
def _(t):
    nir, red = F.col("p_retailprice") - 900, F.col("p_size").cast("double")
    return t.part.select("p_partkey", F.round(scalar.normalised_difference(nir, red), 6).alias("ndvi"))


ERF_SQL = """(sign({x}) * (1 - ((((1.061405429 * (1 / (1 + 0.3275911 * abs({x}))) - 1.453152027) * (1 / (1 + 0.3275911 * abs({x}))) + 1.421413741) * (1 / (1 + 0.3275911 * abs({x})))
    - 0.284496736) * (1 / (1 + 0.3275911 * abs({x}))) + 0.254829592) * (1 / (1 + 0.3275911 * abs({x}))) * exp(-{x} * {x})))"""


@query("fn_erf", "SELECT event_id, round(" + ERF_SQL.format(x="((value - 50) / 40)") + ", 8) AS erf FROM events")
def _(t):
    return t.events.select("event_id", F.round(stats.erf((F.col("value") - 50) / 40), 8).alias("erf"))


@query("fn_norm_ppf", """SELECT event_id, round(CASE WHEN p <= 0 THEN -6 WHEN p >= 1 THEN 6 WHEN p = 0.5 THEN 0 ELSE
    sign(p - 0.5) * (s - (2.515517 + 0.802853 * s + 0.010328 * s * s) / (1 + 1.432788 * s + 0.189269 * s * s + 0.001308 * s * s * s)) END, 8) AS z
    FROM (SELECT event_id, p, sqrt(-2 * ln(CASE WHEN least(p, 1 - p) > 0 THEN least(p, 1 - p) END)) AS s FROM (SELECT event_id, (value - 1) / 100 AS p FROM events))""")
def _(t):
    return t.events.select("event_id", F.round(stats.norm_ppf((F.col("value") - 1) / 100), 8).alias("z"))


@query("fn_sha256", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("fn_normalise", """SELECT event_id, round(CASE WHEN user_id % 10 = 0 THEN 0.5 ELSE greatest(0, least(1, (value - 10) / (user_id % 10 * 10))) END, 6) AS scaled FROM events""")
def _(t):
    low = F.lit(10.0)
    high = low + F.col("user_id") % 10 * 10
    return t.events.select("event_id", F.round(scalar.rescale(F.col("value"), low, high), 6).alias("scaled"))


@query("fn_constraint_penalty", """SELECT event_id, round(greatest(20 - value, 0) + greatest(value - 60, 0), 6) AS outside, round(2 * power(greatest(value - 50, 0), 1.5), 6) AS over,
    round(0.5 * power(greatest(30 - value, 0), 2), 6) AS under FROM events""")
def _(t):
    v = F.col("value")
    return t.events.select(
        "event_id", F.round(scalar.outside_distance(v, 20.0, 60.0), 6).alias("outside"),
        F.round(scalar.threshold_penalty(v, 50.0, 2.0, 1.5), 6).alias("over"),
        F.round(scalar.threshold_penalty(v, 30.0, 0.5, 2.0, upper=False), 6).alias("under"),
    )


@query("fn_softmax", """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) * 10 for x in embedding] AS v FROM embeddings),
    s AS (SELECT vec_id, [exp(x - list_max(v)) for x in v] AS w FROM e)
    SELECT vec_id, round(list_max(w) / list_sum(w), 6) AS top, round(w[1] / list_sum(w), 6) AS first FROM s""")
def _(t):
    p = scalar.softmax(F.transform("embedding", lambda x: x.cast("double") * 10))
    out = t.embeddings.select("vec_id", p.alias("p"))
    return out.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(F.element_at("p", 1), 6).alias("first"))


@query("fn_weighted_score", """SELECT event_id, round(a + b + c, 6) AS score, round(b, 6) AS b_part FROM (SELECT event_id, greatest(0, least(1, value / 100)) * 0.5 AS a,
    coalesce(CASE WHEN user_id % 7 > 0 THEN user_id % 7 / 7 END, 0) * 0.3 AS b, greatest(0, least(1, user_id / 100)) * 0.2 AS c FROM events)""")
def _(t):
    score, parts = scalar.weighted_score({
        "a": (F.col("value") / 100, 5.0), "b": (F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 7 / 7), 3.0),
        "c": (F.col("user_id") / 100, 2.0),
    })
    return t.events.select("event_id", F.round(score, 6).alias("score"), F.round(parts["b"], 6).alias("b_part"))


@query("fn_date_parts", """SELECT o_orderkey, round((dayofyear(o_orderdate) - 1) / 365, 6) AS season, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(month(o_orderdate) AS BIGINT) AS m,
    strftime(CASE o_orderkey % 4 WHEN 0 THEN date_trunc('year', o_orderdate) WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN o_orderdate + INTERVAL 6 HOUR
      ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders""")
def _(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM"))
        .when(k == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T06:00:00Z"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    return t.orders.select(
        "o_orderkey", F.round(scalar.season_fraction(d), 6).alias("season"), F.dayofmonth(d).cast("long").alias("d"),
        F.month(d).cast("long").alias("m"), text_ts(scalar.partial_date(text)).alias("parsed"),
    )


@query("fn_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn_map_pivot", """SELECT c_custkey, 'balance' AS indicator, c_acctbal AS score FROM customer
    UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer""")
def _(t):
    scores = F.create_map(F.lit("balance"), F.col("c_acctbal"), F.lit("nation"), F.col("c_nationkey").cast("double"))
    return t.customer.select("c_custkey", F.explode(scores).alias("indicator", "score"))


@query("fn_string_basics", """SELECT p_partkey, lower(trim(p_brand)) AS brand, split_part(p_name, ' ', 1) AS first_word, starts_with(p_type, 'E') AS starts,
    replace(p_name, ' ', '_') AS joined, regexp_extract(p_brand, '#(\\d+)', 1) AS number, substr(p_type, 1, 3) || '-' || p_size AS code FROM part""")
def _(t):
    return t.part.select(
        "p_partkey", F.lower(F.trim("p_brand")).alias("brand"), F.split("p_name", " ").getItem(0).alias("first_word"),
        F.col("p_type").startswith("E").alias("starts"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("joined"),
        F.regexp_extract("p_brand", r"#(\d+)", 1).alias("number"),
        F.concat(F.substring("p_type", 1, 3), F.lit("-"), F.col("p_size").cast("string")).alias("code"),
    )
