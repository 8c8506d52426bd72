"""Aggregate queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom.functions.scalar import severity_rank
from fieldloom.operators import aggregates as op
from fieldloom.operators.filters import filter_radius
from fieldloom.plans.filters import HAVERSINE_SQL
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with, text_ts
from fieldloom.session import shared_dir
from fieldloom.sources.mergetable import RollupTable


def rounded(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


@query("agg_summary", sql_with("obs", """SELECT variable, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
    min(value) AS min, max(value) AS max, round(skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) AS skewness,
    round(kurtosis_pop(value), 6) AS kurtosis, round(quantile_cont(value, 0.25), 4) AS q25, round(median(value), 4) AS median,
    round(quantile_cont(value, 0.75), 4) AS q75 FROM obs GROUP BY 1"""))
def _(t):
    out = op.summary(t.observations, ["variable"], "value")
    return rounded(rounded(out, 6, "mean", "std", "skewness", "kurtosis"), 4, "q25", "median", "q75")


@query("agg_monthly_means", """SELECT o_orderstatus, CAST(month(o_orderdate) AS BIGINT) AS month, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2""")
def _(t):
    out = op.monthly_means(t.orders, ["o_orderstatus"], "o_totalprice", "o_orderdate")
    return out.select("o_orderstatus", F.col("month").cast("long").alias("month"), F.round("mean", 4).alias("mean"))


@query("agg_continuous_daily", sql_with("obs", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS bucket, station % 16 AS cell, variable,
    round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM obs GROUP BY 1, 2, 3"""))
def _(t):
    out = op.continuous(t.observations.withColumn("cell", F.col("station") % 16), ["cell", "variable"], "value")
    return rounded(out.withColumn("bucket", text_ts("bucket")), 6, "avg_value")


@query("agg_continuous_incremental", sql_with("obs", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS bucket, station % 16 AS cell, variable,
    round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM obs GROUP BY 1, 2, 3"""))
def _(t):
    """The same aggregate after three commits; the later ones bring rows of days that are there already."""
    rows = t.observations.withColumn("cell", F.col("station") % 16)
    table = RollupTable(t.spark, f"{shared_dir(t.spark)}/rollup-{uuid.uuid4().hex}", "cell BIGINT, variable STRING", ["cell", "variable"], "value", max_deltas=2)
    for part in ("event_id % 10 < 8", "event_id % 10 = 8", "event_id % 10 = 9"):
        table.apply(rows.where(part))
    out = table.read().select(text_ts("bucket_ts").alias("bucket"), "cell", "variable", (F.col("total") / F.col("n")).alias("avg_value"), "min_value", "max_value", "n")
    return rounded(out, 6, "avg_value")


@query("agg_pct_of_total", """WITH s AS (SELECT p_brand, p_type, sum(p_retailprice) AS amount FROM part GROUP BY 1, 2)
    SELECT p_brand, p_type, round(amount, 2) AS amount, round(sum(amount) OVER (PARTITION BY p_brand), 2) AS total,
    round(amount / sum(amount) OVER (PARTITION BY p_brand) * 100, 6) AS percentage FROM s""")
def _(t):
    out = op.share_of_total(t.part, ["p_brand"], ["p_type"], "p_retailprice")
    return rounded(rounded(out, 2, "amount", "total"), 6, "percentage")


RICH_SQL = """SELECT region, count(DISTINCT species) AS species_count,
    count(DISTINCT CASE WHEN status IN ('CR', 'EN', 'VU') THEN species END) AS endangered_count,
    round(count(DISTINCT CASE WHEN status IN ('CR', 'EN', 'VU') THEN species END) / count(DISTINCT species), 6) AS vulnerability_ratio
    FROM occ GROUP BY 1 HAVING count(DISTINCT species) >= 50"""


@query("agg_species_richness", sql_with("occ", RICH_SQL))
def _(t):
    return rounded(op.species_richness(t.occurrences, "region", "species", "status", 50), 6, "vulnerability_ratio")


@query("agg_shannon", sql_with("occ", """, c AS (SELECT region, species, count(*) AS c FROM occ GROUP BY 1, 2), n AS (SELECT region, sum(c) AS n FROM c GROUP BY 1)
    SELECT c.region, round(-sum(c / n * ln(c / n)), 6) AS shannon, count(*) AS richness, CAST(max(n) AS BIGINT) AS n FROM c JOIN n ON c.region = n.region GROUP BY 1"""))
def _(t):
    return rounded(op.shannon(t.occurrences, ["region"], "species"), 6, "shannon")


@query("agg_species_summary", sql_with("occ", """SELECT species, count(*) AS observation_count, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS last_observed FROM occ GROUP BY 1"""))
def _(t):
    return op.species_summary(t.occurrences, "species", "observed_at").withColumn("last_observed", text_ts("last_observed"))


AQI_SQL = """CASE parameter
    WHEN 'pm25' THEN CASE WHEN value <= 12 THEN value / 12 * 50 WHEN value <= 35.4 THEN 50 + (value - 12) / 23.4 * 50
        WHEN value <= 55.4 THEN 100 + (value - 35.4) / 20 * 50 WHEN value <= 150.4 THEN 150 + (value - 55.4) / 95 * 50
        WHEN value <= 250.4 THEN 200 + (value - 150.4) / 100 * 100 ELSE 300 + (value - 250.4) / 150 * 200 END
    WHEN 'pm10' THEN CASE WHEN value <= 54 THEN value / 54 * 50 WHEN value <= 154 THEN 50 + (value - 54) / 100 * 50
        ELSE 100 + (value - 154) / 200 * 100 END
    WHEN 'o3' THEN CASE WHEN value <= 54 THEN value / 54 * 50 WHEN value <= 70 THEN 50 + (value - 54) / 16 * 50
        ELSE 100 + (value - 70) / 95 * 100 END
    ELSE least(value * 2, 500) END"""
AQI_SQL = f"CAST(greatest(0, least(500, trunc({AQI_SQL}))) AS BIGINT)"
CATEGORY_SQL = """CASE WHEN aqi <= 50 THEN 'Good' WHEN aqi <= 100 THEN 'Moderate' WHEN aqi <= 150 THEN 'Unhealthy for Sensitive Groups'
    WHEN aqi <= 200 THEN 'Unhealthy' WHEN aqi <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"""
AIR_MIX = "air AS (SELECT event_id, user_id AS station, ts, CASE (user_id + event_id) % 4 WHEN 0 THEN 'pm25' WHEN 1 THEN 'pm10' WHEN 2 THEN 'o3' ELSE 'no2' END AS parameter, value FROM events)"


@query("agg_air_station", f"""WITH {AIR_MIX}, l AS (SELECT station, parameter, arg_max(value, row(ts, event_id)) AS value FROM air GROUP BY 1, 2),
    s AS (SELECT *, {AQI_SQL} AS aqi FROM l),
    g AS (SELECT station, max(aqi) AS aqi, arg_max(parameter, row(aqi, parameter)) AS dominant,
        string_agg(parameter || ':' || aqi, ',' ORDER BY parameter) AS readings FROM s GROUP BY 1)
    SELECT *, {CATEGORY_SQL} AS category FROM g""")
def _(t):
    p = (F.col("station") + F.col("event_id")) % 4
    mixed = t.observations.withColumn(
        "parameter", F.when(p == 0, "pm25").when(p == 1, "pm10").when(p == 2, "o3").otherwise("no2")
    )
    out = op.air_station(mixed)
    text = F.array_join(F.transform("readings", lambda r: F.concat_ws(":", r["parameter"], r["aqi"].cast("string"))), ",")
    return out.withColumn("readings", text).withColumn("aqi", F.col("aqi").cast("long"))


CORR_CTE = """, h AS (SELECT date_trunc('hour', ts) AS at, """ + ", ".join(
    f"avg(CASE WHEN variable = '{v}' THEN value END) AS {v}" for v in ("click", "error", "purchase", "signup", "view")
) + " FROM obs GROUP BY 1)"
PAIRS = [(a, b) for i, a in enumerate(("click", "error", "purchase", "signup", "view")) for b in ("click", "error", "purchase", "signup", "view")[i + 1:]]


@query("agg_correlation", sql_with("obs", CORR_CTE + " UNION ALL ".join(
    f" SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM h" for a, b in PAIRS)))
def _(t):
    variables = ["click", "error", "purchase", "signup", "view"]
    wide = op.pivot_series(t.observations, F.date_trunc("hour", "ts"), variables, "variable", "value")
    return op.correlations(wide, variables).select("a", "b", F.round("r", 6).alias("r"), "n")


@query("agg_trend", """WITH y AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS DOUBLE) AS yr, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2),
    s AS (SELECT o_orderpriority, regr_slope(m, yr) * 10 AS per_decade, regr_r2(m, yr) AS r2, count(*) AS years FROM y GROUP BY 1)
    SELECT o_orderpriority, round(per_decade, 4) AS per_decade, round(r2, 6) AS r2, years,
      CASE WHEN per_decade > 0 THEN 'increasing' WHEN per_decade < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM s""")
def _(t):
    out = op.trend(t.orders, ["o_orderpriority"], "o_totalprice", F.year("o_orderdate"))
    return rounded(rounded(out, 4, "per_decade"), 6, "r2").drop("p_value")


@query("agg_baseline_anomaly", sql_with("obs", """, b AS (SELECT variable, avg(value) AS m, stddev_samp(value) AS s FROM obs WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT event_id, o.variable, value, round((value - m) / s, 6) AS z, round(m - 2 * s, 6) AS lower, round(m + 2 * s, 6) AS upper,
      CASE WHEN abs((value - m) / s) >= 4 THEN 'critical' WHEN abs((value - m) / s) >= 3 THEN 'high' WHEN abs((value - m) / s) >= 2 THEN 'medium' ELSE 'low' END AS severity
    FROM obs o JOIN b ON o.variable = b.variable WHERE ts >= TIMESTAMP '2024-01-20' AND abs((value - m) / s) >= 2"""))
def _(t):
    cut = F.lit("2024-01-20").cast("timestamp")
    out = op.baseline_anomaly(t.observations.where(F.col("ts") >= cut), t.observations.where(F.col("ts") < cut), ["variable"], "value")
    return rounded(out, 6, "z", "lower", "upper").select("event_id", "variable", "value", "z", "lower", "upper", "severity")


@query("agg_quality_report", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_shipdate,
      CASE WHEN l_orderkey % 9 <> 0 THEN l_tax END AS l_tax FROM lineitem),
    b AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp FROM r),
    w AS (SELECT count(*) AS rows, count(*) FILTER (l_tax IS NULL) / (count(*) * 2) * 100 AS missing_pct,
      (count(*) FILTER (abs(l_quantity - mq) > 3 * sq) + count(*) FILTER (abs(l_extendedprice - mp) > 3 * sp)) / (count(*) * 2) * 100 AS outlier_pct,
      count(*) FILTER (NOT l_discount < 0.09) / count(*) * 100 AS broken_discount_pct, max(l_shipdate) AS last_update FROM r, b),
    d AS (SELECT sum(c - 1) / sum(c) * 100 AS duplicate_pct FROM (SELECT count(*) AS c FROM r GROUP BY l_orderkey, l_linenumber))
    SELECT rows, round(missing_pct, 6) AS missing_pct, round(outlier_pct, 6) AS outlier_pct, round(broken_discount_pct, 6) AS broken_discount_pct,
      strftime(last_update, '%Y-%m-%d %H:%M:%S') AS last_update, round(duplicate_pct, 6) AS duplicate_pct,
      round((400 - missing_pct - duplicate_pct - outlier_pct - broken_discount_pct) / 4, 6) AS overall FROM w, d""")
def _(t):
    rows = t.lineitem.withColumn("l_tax", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_tax")))
    out = op.quality_report(
        rows, ["l_tax", "l_quantity"], ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"],
        {"discount": F.col("l_discount") < 0.09}, "l_shipdate",
    )
    out = rounded(out, 6, "missing_pct", "outlier_pct", "broken_discount_pct", "duplicate_pct", "overall")
    return out.withColumn("last_update", text_ts("last_update"))


@query("agg_change_pct", sql_with("predictions", """SELECT l_orderkey, l_linenumber, round((y_pred - y_true) / nullif(y_true, 0) * 100, 6) AS change_pct FROM predictions"""))
def _(t):
    return t.predictions.select(
        "l_orderkey", "l_linenumber", F.round(op.change_pct(F.col("y_pred"), F.col("y_true")), 6).alias("change_pct")
    )


@query("agg_allocation", """WITH n AS (SELECT CAST(c_nationkey AS BIGINT) AS region, sum(c_acctbal + 1000) AS need FROM customer GROUP BY 1),
    x AS (SELECT region, need / (SELECT sum(need) FROM n) AS share FROM n),
    f AS (SELECT region, share, floor(share * 100000000) AS fl, share * 100000000 - floor(share * 100000000) AS rest FROM x),
    r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, region) AS rk, 100000000 - sum(fl) OVER () AS lft FROM f)
    SELECT region, CAST(fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS cents, round(share * 100, 6) AS allocation_pct FROM r""")
def _(t):
    need = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("region")).agg(F.sum(F.col("c_acctbal") + 1000).alias("need"))
    return rounded(op.allocate(need, "region", "need", 100_000_000), 6, "allocation_pct")


GINI_SQL = """SELECT {k}, round(coalesce(2 * sum(i * x) / (count(*) * nullif(sum(x), 0)) - (count(*) + 1) / count(*), 0), 6) AS gini, count(*) AS n
    FROM (SELECT {k}, {x} AS x, row_number() OVER (PARTITION BY {k} ORDER BY {x}) AS i FROM {t}) GROUP BY 1"""


@query("agg_gini", GINI_SQL.format(k="event_type", x="value", t="events"))
def _(t):
    return rounded(op.gini(t.events, ["event_type"], "value"), 6, "gini")


@query("agg_fairness", sql_with("episodes", """, m AS (SELECT policy, sector, avg(reward) AS m FROM episodes GROUP BY 1, 2),
    r AS (SELECT policy, m, row_number() OVER (PARTITION BY policy ORDER BY m) AS i FROM m)
    SELECT policy, round(min(m) / max(m), 6) AS min_max_ratio, round(stddev_pop(m) / avg(m), 6) AS cv,
      round(2 * sum(i * m) / (count(*) * sum(m)) - (count(*) + 1) / count(*), 6) AS gini FROM r GROUP BY 1"""))
def _(t):
    return rounded(op.fairness(t.episodes, ["policy"], "sector", "reward"), 6, "min_max_ratio", "cv", "gini")


@query("agg_policy", sql_with("episodes", """, e AS (SELECT policy, episode, sum(reward) AS r, count(*) AS len FROM episodes GROUP BY 1, 2)
    SELECT policy, count(*) AS episodes, round(avg(r), 6) AS mean_reward, round(stddev_pop(r), 6) AS std_reward, round(min(r), 6) AS min_reward,
      round(max(r), 6) AS max_reward, round(avg(len), 6) AS mean_length, round(avg(CASE WHEN r >= 100 THEN 1 ELSE 0 END), 6) AS success_rate FROM e GROUP BY 1"""))
def _(t):
    out = op.policy_summary(t.episodes, "policy", "episode", "reward", 100.0)
    return rounded(out, 6, "mean_reward", "std_reward", "min_reward", "max_reward", "mean_length", "success_rate")


@query("agg_histogram", sql_with("obs", """, s AS (SELECT variable, min(value) AS lo, max(value) AS hi FROM obs GROUP BY 1),
    c AS (SELECT o.variable, least(floor((value - lo) / (hi - lo) * 50), 49) AS bin, count(*) AS n FROM obs o JOIN s ON o.variable = s.variable GROUP BY 1, 2)
    SELECT s.variable, CAST(b.bin AS BIGINT) AS bin, coalesce(c.n, 0) AS n FROM s CROSS JOIN (SELECT unnest(range(50)) AS bin) b
    LEFT JOIN c ON c.variable = s.variable AND c.bin = b.bin"""))
def _(t):
    return op.histogram(t.observations, ["variable"], "value", 50)


@query("agg_first_last", sql_with("features", """SELECT entity, arg_max(price, row(ts, seq)) FILTER (price IS NOT NULL) AS last_price, arg_max(state, row(ts, seq)) FILTER (state IS NOT NULL) AS last_state,
    arg_min(price, row(ts, seq)) FILTER (price IS NOT NULL) AS first_price FROM features GROUP BY 1"""))
def _(t):
    last = op.last_non_null(t.features, ["entity"], ["price", "state"], ["ts", "seq"])
    first = op.last_non_null(t.features, ["entity"], ["price"], ["ts", "seq"], last=False)
    return last.join(first.withColumnRenamed("price", "first_price"), "entity").select(
        "entity", F.col("price").alias("last_price"), F.col("state").alias("last_state"), "first_price"
    )


@query("agg_grouping", """SELECT coalesce(r_name, '*') AS region, coalesce(c_mktsegment, '*') AS segment, n, level, mean FROM (
    SELECT r_name, c_mktsegment, CAST(grouping(r_name, c_mktsegment) AS BIGINT) AS level, count(*) AS n, round(avg(c_acctbal), 6) AS mean
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment))""")
def _(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    out = rounded(op.rollup_levels(c, ["r_name", "c_mktsegment"], "c_acctbal"), 6, "mean")
    return out.select(
        F.coalesce("r_name", F.lit("*")).alias("region"), F.coalesce("c_mktsegment", F.lit("*")).alias("segment"),
        "n", "level", "mean",
    )


@query("agg_cube", sql_with("obs", """SELECT coalesce(variable, '*') AS variable, coalesce(severity, '*') AS severity, CAST(level AS BIGINT) AS level, n, round(mean, 6) AS mean FROM (
    SELECT variable, severity, grouping(variable, severity) AS level, count(*) AS n, avg(value) AS mean FROM (
      SELECT variable, value, CASE WHEN value > 90 THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END AS severity FROM obs) GROUP BY CUBE (variable, severity))"""))
def _(t):
    sev = F.when(F.col("value") > 90, "high").when(F.col("value") > 50, "medium").otherwise("low")
    out = op.cube_levels(t.observations.withColumn("severity", sev), ["variable", "severity"], "value")
    return rounded(out, 6, "mean").withColumn("variable", F.coalesce("variable", F.lit("*"))).withColumn(
        "severity", F.coalesce("severity", F.lit("*"))
    )


DASH_SQL = """, p AS (SELECT CASE variable WHEN 'click' THEN 'climate' WHEN 'error' THEN 'biodiversity' WHEN 'purchase' THEN 'health'
      WHEN 'signup' THEN 'food_security' ELSE 'resources' END AS domain, value FROM obs),
    d AS (SELECT domain, avg(value) AS metric, count(*) FILTER (value > 120) AS alerts,
      max(CASE WHEN value > 200 THEN 5 WHEN value > 120 THEN 4 WHEN value > 60 THEN 3 ELSE 2 END) AS risk_rank FROM p GROUP BY 1)
    SELECT domain, round(metric, 6) AS metric, alerts, CAST(risk_rank AS BIGINT) AS risk_rank FROM d
    UNION ALL SELECT 'all', NULL, CAST(sum(alerts) AS BIGINT), CAST(max(risk_rank) AS BIGINT) FROM d"""


@query("agg_dashboard", sql_with("obs", DASH_SQL))
def _(t):
    domains = {"click": "climate", "error": "biodiversity", "purchase": "health", "signup": "food_security", "view": "resources"}
    v = F.col("value")
    risk = F.when(v > 200, "critical").when(v > 120, "high").when(v > 60, "medium").otherwise("low")
    name = F.create_map(*[F.lit(x) for pair in domains.items() for x in pair])
    per = t.observations.groupBy(F.element_at(name, F.col("variable")).alias("domain")).agg(
        F.avg(v).alias("metric"), F.count_if(v > 120).alias("alerts"), F.max(severity_rank(risk)).alias("risk_rank")
    )
    return rounded(op.dashboard(per), 6, "metric").withColumn("risk_rank", F.col("risk_rank").cast("long"))


@query("agg_report", sql_with("points stations", f"""SELECT 'customers' AS section, count(*) AS n, round(sum(c_acctbal), 2) AS amount FROM (SELECT c_acctbal,
      {HAVERSINE_SQL.format(lon1='lon', lat1='lat', lon2='10.0', lat2='20.0')} AS d FROM points) WHERE d <= 3000000
    UNION ALL SELECT 'readings', count(*), round(sum(value), 2) FROM events JOIN (SELECT station,
      {HAVERSINE_SQL.format(lon1='lon', lat1='lat', lon2='10.0', lat2='20.0')} AS d FROM stations) ON user_id = station WHERE d <= 3000000"""))
def _(t):
    near = filter_radius(t.stations, 10.0, 20.0, 3_000_000, "station", limit=None)
    people = filter_radius(t.points, 10.0, 20.0, 3_000_000, "id", limit=None)
    readings = t.observations.join(near, "station")
    return people.agg(
        F.lit("customers").alias("section"), F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("amount")
    ).unionByName(readings.agg(
        F.lit("readings").alias("section"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("amount")
    ))
