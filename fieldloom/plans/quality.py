"""Gates, clean-up, and the flagship report."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions.scalar import severity_of_z, unit_convert
from fieldloom.operators import quality as op
from fieldloom.operators import timeseries as ts_op
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with, text_ts
from fieldloom.schemas import Check, in_range, one_of, present



def event_checks() -> list[Check]:
    return [
        in_range("value", 0.5, 120.0), one_of("event_type", ["click", "error", "purchase", "signup"]), present("user_id"),
        Check("station_range", F.col("user_id") < 1_000_000),
    ]


GATE_SQL = """CASE WHEN NOT (value >= 0.5 AND value <= 120) THEN 'value_range' END,
    CASE WHEN event_type NOT IN ('click', 'error', 'purchase', 'signup') THEN 'event_type_value' END,
    CASE WHEN user_id IS NULL THEN 'user_id_missing' END,
    CASE WHEN NOT user_id < 1000000 THEN 'station_range' END"""


@query("quality_gate", f"SELECT event_id, nullif(concat_ws(',', {GATE_SQL}), '') AS reasons FROM events")
def _(t):
    good, bad = op.quality_gate(t.events, event_checks())
    return good.select("event_id", F.lit(None).cast("string").alias("reasons")).unionByName(
        bad.select("event_id", F.array_join("reasons", ",").alias("reasons"))
    )


@query("normalize_coords", """WITH raw AS (SELECT c_custkey AS id,
    CASE WHEN c_custkey % 7 <> 0 THEN CAST((c_custkey * 7919 % 40000) / 100.0 - 200 AS DOUBLE) END AS a,
    CASE WHEN c_custkey % 13 <> 0 THEN CAST((c_custkey * 104729 % 24000) / 100.0 - 120 AS DOUBLE) END AS b FROM customer),
    placed AS (SELECT id, CASE WHEN swap THEN b ELSE a END AS lat, CASE WHEN swap THEN a ELSE b END AS lon
        FROM raw, (SELECT count(*) FILTER (abs(a) > 90) * 2 > count(a) AS swap FROM raw))
    SELECT id, CASE WHEN lat IS NOT NULL THEN greatest(-90.0, least(90.0, lat)) END AS latitude,
        CASE WHEN lon IS NOT NULL THEN greatest(-180.0, least(180.0, lon)) END AS longitude FROM placed""")
def _(t):
    k = F.col("c_custkey")
    raw = t.customer.select(
        k.alias("id"),
        F.when(k % 7 == 0, "n/a").otherwise(((k * 7919 % 40000) / F.lit(100.0) - 200).cast("string")).alias("Lat"),
        F.when(k % 13 != 0, (k * 104729 % 24000) / F.lit(100.0) - 120).alias("LNG"),
    )
    return op.normalize_coords(raw)


@query("unit_convert", """SELECT event_id, CASE event_type WHEN 'click' THEN '°C' WHEN 'error' THEN 'mm' WHEN 'view' THEN 'hPa' ELSE 'm/s' END AS unit,
    round(CASE event_type WHEN 'click' THEN value - 273.15 WHEN 'error' THEN value * 1000 WHEN 'view' THEN value / 100 ELSE value END, 6) AS value FROM events""")
def _(t):
    kind = F.col("event_type")
    variable = (
        F.when(kind == "click", "2m_temperature").when(kind == "error", "total_precipitation")
        .when(kind == "view", "surface_pressure").otherwise("10m_u_component_of_wind")
    )
    unit = F.when(kind == "click", "K").when(kind == "error", "m").when(kind == "view", "Pa").otherwise("m/s")
    value, new_unit = unit_convert(variable, unit, F.col("value"))
    return t.events.select("event_id", new_unit.alias("unit"), F.round(value, 6).alias("value"))


@query("sanitize_text", r"""SELECT doc_id, md5(regexp_replace(replace(substr('  ' || text, 1, 1000), chr(0), ''), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", F.md5(op.sanitize_text(F.concat(F.lit("  "), F.col("text")))).alias("digest")
    )


@query("flag_unsafe_text", r"""SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 10 = 0 THEN ' Detach x' ELSE '' END,
    '(?i)\bDROP\b|\bDELETE\b|\bDETACH\b|\bCALL\b.*\bdbms\b|\bLOAD\s+CSV\b') AS unsafe FROM documents""")
def _(t):
    text = F.concat("text", F.when(F.col("doc_id") % 10 == 0, " Detach x").otherwise(""))
    return t.documents.select("doc_id", op.unsafe_text(text).alias("unsafe"))


@query("validate_schema", """SELECT 'l_comment' AS column_name, 'missing' AS problem
    UNION ALL SELECT 'l_returnflag', 'expected double, found string' WHERE (SELECT count(*) FROM lineitem) > 0""")
def _(t):
    problems = op.validate_schema(
        t.lineitem, {"l_orderkey": "int", "l_comment": "string", "l_returnflag": "double", "l_shipdate": "timestamp"}
    )
    seen = t.lineitem.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("problem")) for c, p in problems]))
    return seen.select(rows.alias("r")).select("r.*")


@query("guarded_process", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 0 GROUP BY 1")
def _(t):
    out, _, _ = op.guarded(
        t.events,
        lambda df: df.where("value > 0").groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
        ),
        {"event_type": "string", "value": "double"}, {"total": "double"},
    )
    return out


@query("flatten_props", """SELECT event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS reading_at, value AS reading_value,
    user_id || '|' || event_type AS reading_tags FROM events""")
def _(t):
    nested = t.events.select(
        "event_id", "event_type",
        F.struct(
            F.col("ts").alias("at"), "value", F.array(F.col("user_id").cast("string"), "event_type").alias("tags")
        ).alias("reading"),
    )
    return op.flatten_props(nested).withColumn("reading_tags", F.array_join("reading_tags", "|"))


DAILY_SQL = """, good AS (SELECT * FROM obs WHERE value >= 0.02 AND station IS NOT NULL),
    days AS (SELECT variable, date_trunc('day', ts) AS day, avg(value) AS mean, min(value) AS low, max(value) AS high, count(*) AS n
             FROM good GROUP BY 1, 2),
    base AS (SELECT variable, avg(mean) AS m, stddev_samp(mean) AS s FROM days GROUP BY 1)
    SELECT d.variable, strftime(day, '%Y-%m-%d %H:%M:%S') AS day, round(mean, 6) AS mean, low, high, n, round((mean - m) / s, 6) AS z,
      CASE WHEN abs((mean - m) / s) >= 4 THEN 'critical' WHEN abs((mean - m) / s) >= 3 THEN 'high'
           WHEN abs((mean - m) / s) >= 2 THEN 'medium' ELSE 'low' END AS severity
    FROM days d JOIN base b ON d.variable = b.variable WHERE abs(mean - m) > 1.5 * s
    ORDER BY abs((mean - m) / s) DESC, d.variable, day LIMIT 25"""


@query("daily_anomaly_report", sql_with("obs", DAILY_SQL))
def _(t):
    good, _ = op.quality_gate(t.observations, [in_range("value", 0.02), present("station")])
    days = good.groupBy("variable", F.date_trunc("day", "ts").alias("day")).agg(
        F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.count(F.lit(1)).alias("n"),
    )
    flagged = ts_op.anomalies_z(days, ["variable"], "mean", 1.5)
    top = flagged.orderBy(F.desc(F.abs("z")), "variable", "day").limit(25)
    return top.select(
        "variable", text_ts("day").alias("day"), F.round("mean", 6).alias("mean"), "low", "high", "n",
        F.round("z", 6).alias("z"), severity_of_z(F.col("z")).alias("severity"),
    )
