"""Composite index and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import scores as op
from fieldloom.plans.aggregates import rounded
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with, text_ts

LEVEL = "CASE WHEN {x} < 0.25 THEN 'low' WHEN {x} < 0.5 THEN 'moderate' WHEN {x} < 0.75 THEN 'high' ELSE 'extreme' END"


@query("sc_ecosystem", sql_with("occ", """, y AS (SELECT region, CAST(year(observed_at) AS DOUBLE) AS yr, count(DISTINCT species) / 200 AS richness, avg(quantity) / 50 AS habitat,
      count(DISTINCT l_linenumber) / 7 AS connectivity, avg(CASE WHEN status IN ('CR', 'EN') THEN 1 ELSE 0 END) AS threat FROM occ GROUP BY 1, 2),
    s AS (SELECT region, yr, (least(1, richness) + least(1, habitat) + least(1, connectivity) + 1 - threat) / 4 AS overall FROM y)
    SELECT region, round(avg(overall), 6) AS overall, CASE WHEN regr_slope(overall, yr) > 0.001 THEN 'improving' WHEN regr_slope(overall, yr) < -0.001 THEN 'declining' ELSE 'stable' END AS trend FROM s GROUP BY 1"""))
def _(t):
    yearly = t.occurrences.groupBy("region", F.year("observed_at").cast("double").alias("yr")).agg(
        (F.countDistinct("species") / 200).alias("richness"), (F.avg("quantity") / 50).alias("habitat"),
        (F.countDistinct("l_linenumber") / 7).alias("connectivity"), F.avg(F.col("status").isin("CR", "EN").cast("double")).alias("threat"),
    )
    scored = yearly.withColumn("score", op.ecosystem_score(F.col("richness"), F.col("habitat"), F.col("connectivity"), F.col("threat")))
    out = scored.groupBy("region").agg(F.avg("score").alias("overall"), F.regr_slope("score", "yr").alias("slope"))
    return out.select("region", F.round("overall", 6).alias("overall"), op.trend_label(F.col("slope"), 0.001).alias("trend"))


@query("sc_status_counts", sql_with("occ", """SELECT status, count(DISTINCT species) AS species_count, round(count(DISTINCT species) / (SELECT count(DISTINCT species) FROM occ), 6) AS share,
    status IN ('CR', 'EN', 'VU') AS threatened FROM occ GROUP BY 1"""))
def _(t):
    return rounded(op.status_counts(t.occurrences, "species", "status"), 6, "share")


HEAT = """(CASE WHEN (0.5 * (f + 61 + (f - 68) * 1.2 + r * 0.094) + f) / 2 < 80 THEN 0.5 * (f + 61 + (f - 68) * 1.2 + r * 0.094) ELSE -42.379 + 2.04901523 * f + 10.14333127 * r - 0.22475541 * f * r
    - 0.00683783 * f * f - 0.05481717 * r * r + 0.00122874 * f * f * r + 0.00085282 * f * r * r - 0.00000199 * f * f * r * r END - 32) * 5 / 9"""


@query("sc_heat", f"""WITH b AS (SELECT event_id, (20 + value / 6) * 9 / 5 + 32 AS f, CAST(30 + user_id % 60 AS DOUBLE) AS r, event_id % 10 / 10 AS sens, user_id % 8 / 8 AS cap FROM events), h AS (SELECT *, {HEAT} AS hi FROM b),
    s AS (SELECT *, (greatest(0, least(1, (hi - 27) / 27)) + sens + 1 - cap) / 3 AS score FROM h)
    SELECT event_id, round(hi, 6) AS heat_index, round(score, 6) AS score, {LEVEL.format(x='score')} AS level FROM s""")
def _(t):
    index, score = op.heat_vulnerability(
        20 + F.col("value") / 6, (30 + F.col("user_id") % 60).cast("double"), F.col("event_id") % 10 / 10, F.col("user_id") % 8 / 8
    )
    out = t.events.select("event_id", index.alias("heat_index"), score.alias("score"))
    return rounded(out.withColumn("level", op.level_of(F.col("score"))), 6, "heat_index", "score")


@query("sc_vector_risk", sql_with("obs", """, f AS (SELECT station, variable AS factor, avg(greatest(0, least(1, value / 100))) AS v FROM obs GROUP BY 1, 2),
    w AS (SELECT DISTINCT 'disease ' || (o_orderkey % 4) AS disease, ['click', 'error', 'purchase', 'signup', 'view'][CAST(o_orderkey % 5 + 1 AS INT)] AS factor, CAST(o_orderkey % 5 + o_orderkey % 4 + 1 AS DOUBLE) AS weight FROM orders),
    r AS (SELECT station, disease, sum(v * weight) / sum(weight) AS risk FROM f JOIN w ON f.factor = w.factor GROUP BY 1, 2)
    SELECT station, round(max(risk), 6) AS overall, arg_max(disease, row(risk, disease)) AS worst FROM r GROUP BY 1"""))
def _(t):
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(v) for v in ("click", "error", "purchase", "signup", "view")])
    factors = t.orders.select(
        F.concat(F.lit("disease "), (k % 4).cast("string")).alias("disease"), F.element_at(names, (k % 5 + 1).cast("int")).alias("factor"),
        (k % 5 + k % 4 + 1).cast("double").alias("weight"),
    ).distinct()
    rows = t.observations.select("station", F.col("variable").alias("factor"), (F.col("value") / 100).alias("value"))
    return rounded(op.overall_risk(op.vector_risk(rows, ["station"], factors), ["station"]), 6, "overall")


@query("sc_water_quality", sql_with("air", """, m AS (SELECT station % 30 AS site, event_type AS parameter, avg(value) AS v FROM air GROUP BY 1, 2),
    s AS (SELECT site, parameter, CASE WHEN v < 10 THEN 95 WHEN v < 20 THEN 80 WHEN v < 40 THEN 60 WHEN v < 60 THEN 40 ELSE 10 END AS sub, length(parameter) AS w FROM m)
    SELECT site, round(sum(sub * w) / sum(w), 6) AS wqi, CASE WHEN sum(sub * w) / sum(w) >= 90 THEN 'excellent' WHEN sum(sub * w) / sum(w) >= 70 THEN 'good' WHEN sum(sub * w) / sum(w) >= 50 THEN 'medium'
      WHEN sum(sub * w) / sum(w) >= 25 THEN 'bad' ELSE 'very bad' END AS category FROM s GROUP BY 1"""))
def _(t):
    kinds = t.air.select(F.col("event_type").alias("parameter")).distinct()
    bands = F.array(*[
        F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(s).alias("sub_index"))
        for lo, hi, s in ((0.0, 10.0, 95.0), (10.0, 20.0, 80.0), (20.0, 40.0, 60.0), (40.0, 60.0, 40.0), (60.0, 1e9, 10.0))
    ])
    thresholds = kinds.select("parameter", F.explode(bands).alias("b")).select("parameter", "b.*")
    weights = kinds.select("parameter", F.length("parameter").cast("double").alias("weight"))
    rows = t.air.select((F.col("station") % 30).alias("site"), F.col("event_type").alias("parameter"), "value")
    return rounded(op.water_quality(rows, ["site"], thresholds, weights), 6, "wqi")


DROUGHT_SQL = """, p AS (SELECT event_id, percent_rank() OVER (PARTITION BY station ORDER BY value) * 100 AS p FROM obs)
    SELECT event_id, round(p, 6) AS percentile, CASE WHEN p <= 2 THEN 'D4' WHEN p <= 5 THEN 'D3' WHEN p <= 10 THEN 'D2' WHEN p <= 20 THEN 'D1' WHEN p <= 30 THEN 'D0' ELSE 'none' END AS drought FROM p"""


@query("sc_drought", sql_with("obs", DROUGHT_SQL))
def _(t):
    return rounded(op.drought(t.observations, "station", "value"), 6, "percentile").select("event_id", "percentile", "drought")


@query("sc_drought_index", sql_with("obs", """, s AS (SELECT event_id, station, sum(value) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS t FROM obs),
    b AS (SELECT station, avg(t) AS m, stddev_samp(t) AS s FROM s GROUP BY 1) SELECT event_id, round((t - m) / b.s, 6) AS index FROM s JOIN b ON s.station = b.station"""))
def _(t):
    out = op.standardised_index(t.observations, ["station"], [F.col("ts"), F.col("event_id")], "value", 10)
    return rounded(out, 6, "index").select("event_id", "index")


@query("sc_food_index", """WITH c AS (SELECT c_nationkey, c_acctbal, (greatest(0, least(1, c_acctbal / 10000)) + c_custkey % 7 / 7 + c_custkey % 11 / 11 + c_custkey % 5 / 5) / 4 AS score, 1 + c_custkey % 1000 AS people FROM customer)
    SELECT CAST(c_nationkey AS BIGINT) AS region, round(sum(score * people) / sum(people), 6) AS overall, CAST(sum(people) AS BIGINT) AS people,
      count(*) FILTER (score < 0.4) AS severe FROM c GROUP BY 1""")
def _(t):
    k = F.col("c_custkey")
    score = op.food_index(F.col("c_acctbal") / 10000, k % 7 / 7, k % 11 / 11, k % 5 / 5)
    rows = t.customer.select(F.col("c_nationkey").cast("long").alias("region"), score.alias("score"), (1 + k % 1000).alias("people"))
    return rounded(rows.groupBy("region").agg(
        (F.sum(F.col("score") * F.col("people")) / F.sum("people")).alias("overall"), F.sum("people").alias("people"),
        F.count_if(op.food_class(F.col("score")) == "severely insecure").alias("severe"),
    ), 6, "overall")


@query("sc_water_stress", """WITH d AS (SELECT CAST(c_nationkey AS BIGINT) AS region, sum(o_totalprice) / 1e6 AS demand FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    s AS (SELECT CAST(c_nationkey AS BIGINT) AS region, sum(c_acctbal) / 1e3 AS supply FROM customer GROUP BY 1)
    SELECT d.region, round(demand / supply, 6) AS ratio, CASE WHEN demand / supply < 0.1 THEN 'low' WHEN demand / supply < 0.2 THEN 'low-medium' WHEN demand / supply < 0.4 THEN 'medium-high'
      WHEN demand / supply < 0.8 THEN 'high' ELSE 'extremely high' END AS severity FROM d JOIN s ON d.region = s.region""")
def _(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("region"), "c_acctbal")
    demand = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("region").agg((F.sum("o_totalprice") / 1e6).alias("demand"))
    supply = c.groupBy("region").agg((F.sum("c_acctbal") / 1e3).alias("supply"))
    ratio, severity = op.water_stress(F.col("demand"), F.col("supply"))
    return demand.join(supply, "region").select("region", F.round(ratio, 6).alias("ratio"), severity.alias("severity"))


@query("sc_env_justice", """WITH p AS (SELECT c_custkey, percent_rank() OVER (ORDER BY c_acctbal) * 100 AS a, percent_rank() OVER (ORDER BY c_custkey % 97) * 100 AS b, percent_rank() OVER (ORDER BY c_custkey % 13) * 100 AS c FROM customer),
    s AS (SELECT c_custkey, (a + b) / 2 AS burden, c AS health FROM p)
    SELECT c_custkey, round(burden, 6) AS burden, round(health, 6) AS health, round((burden + health) / 2, 6) AS overall,""" + LEVEL.format(x="((burden + health) / 200)") + " AS class FROM s")
def _(t):
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("income"), (k % 97).alias("exposure"), (k % 13).alias("illness"))
    out = op.env_justice(rows, "c_custkey", {"burden": ["income", "exposure"], "health": ["illness"]})
    return rounded(out, 6, "burden", "health", "overall")


@query("sc_energy", """WITH u AS (SELECT CAST(c_nationkey AS BIGINT) AS region, c_acctbal + 1000 AS use, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1000 ELSE 0 END AS renew, 1 + c_custkey % 9 AS people, c_custkey % 10 <> 0 AS access FROM customer),
    b AS (SELECT region, avg(CAST(access AS INT)) AS access_share, sum(renew) / sum(use) AS renewable_share, sum(use) / sum(people) AS use_per_head FROM u GROUP BY 1),
    r AS (SELECT region, use / people AS h, row_number() OVER (PARTITION BY region ORDER BY use / people) AS i FROM u),
    g AS (SELECT region, 1 - (2 * sum(i * h) / (count(*) * sum(h)) - (count(*) + 1) / count(*)) AS equity FROM r GROUP BY 1)
    SELECT b.region, round(access_share, 6) AS access_share, round(renewable_share, 6) AS renewable_share, round(use_per_head, 6) AS use_per_head, round(equity, 6) AS equity FROM b JOIN g ON b.region = g.region""")
def _(t):
    k, use = F.col("c_custkey"), F.col("c_acctbal") + 1000
    rows = t.customer.select(
        F.col("c_nationkey").cast("long").alias("region"), use.alias("use"), F.when(k % 3 == 0, use).otherwise(0.0).alias("renew"),
        (1 + k % 9).alias("people"), (k % 10 != 0).alias("access"),
    )
    return rounded(op.energy(rows, ["region"], "use", "renew", "people", "access"), 6, "access_share", "renewable_share", "use_per_head", "equity")


FORECAST_SQL = """, r AS (SELECT variable, epoch(ts) // 1 AS es, hour(ts) AS h, ts, value FROM obs),
    s AS (SELECT variable, min(floor(es) / 3600) AS t0, max(ts) AS last FROM r GROUP BY 1),
    x AS (SELECT r.variable, floor(es) / 3600 - t0 AS x, h, value FROM r JOIN s ON r.variable = s.variable),
    l AS (SELECT variable, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM x GROUP BY 1),
    d AS (SELECT x.variable, h, value - a - b * x AS d FROM x JOIN l ON x.variable = l.variable),
    m AS (SELECT variable, h, avg(d) AS s, var_pop(d) AS v, count(*) AS n FROM d GROUP BY 1, 2),
    e AS (SELECT variable, sqrt(sum(v * n) / sum(n)) AS std FROM m GROUP BY 1),
    f AS (SELECT s.variable, t0, a, b, std, make_timestamp(CAST((floor(epoch(last)) + i * 3600) * 1000000 AS BIGINT)) AS ts FROM s JOIN l ON s.variable = l.variable JOIN e ON s.variable = e.variable CROSS JOIN (SELECT unnest(range(1, 49)) AS i)),
    p AS (SELECT f.variable, f.ts, std, a + b * (epoch(f.ts) / 3600 - t0) + coalesce(m.s, 0) AS p FROM f LEFT JOIN m ON f.variable = m.variable AND m.h = hour(f.ts))
    SELECT variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(p, 4) AS predicted, round(p - 1.96 * std, 4) AS lower, round(p + 1.96 * std, 4) AS upper FROM p"""


@query("fc_baseline", sql_with("obs", FORECAST_SQL))
def _(t):
    out = op.forecast_baseline(t.observations, ["variable"], "value", "ts", 48)
    return rounded(out.withColumn("ts", text_ts("ts")), 4, "predicted", "lower", "upper")
