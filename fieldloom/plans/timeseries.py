"""Series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import timeseries as op
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with, text_ts

TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("ts_resample", sql_with("gappy", """, b AS (SELECT variable, date_trunc('hour', ts) AS ts, avg(value) AS value FROM obs GROUP BY 1, 2),
    spine AS (SELECT variable, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY 1)
    SELECT s.variable, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(b.value, 6) AS value
    FROM spine s LEFT JOIN b ON s.variable = b.variable AND s.ts = b.ts"""))
def _(t):
    out = op.resample(t.observations, ["variable"], "value", 3600, "mean")
    return out.select("variable", text_ts("ts").alias("ts"), F.round("value", 6).alias("value"))


@query("ts_resample_sum", sql_with("obs", """, b AS (SELECT station, date_trunc('day', ts) AS ts, sum(value) AS value FROM obs GROUP BY 1, 2),
    spine AS (SELECT station, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM b GROUP BY 1)
    SELECT s.station, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(b.value, 0), 2) AS value
    FROM spine s LEFT JOIN b ON s.station = b.station AND s.ts = b.ts"""))
def _(t):
    out = op.resample(t.observations, ["station"], "value", 86400, "sum")
    return out.select("station", text_ts("ts").alias("ts"), F.round("value", 2).alias("value"))


@query("ts_resample_median", sql_with("obs", """, b AS (SELECT variable, date_trunc('day', ts) AS ts, median(value) AS value FROM obs GROUP BY 1, 2)
    SELECT variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 4) AS value FROM b"""))
def _(t):
    out = op.resample(t.observations, ["variable"], "value", 86400, "median").where("value IS NOT NULL")
    return out.select("variable", text_ts("ts").alias("ts"), F.round("value", 4).alias("value"))


@query("ts_anomaly_z", sql_with("obs", """, b AS (SELECT variable, avg(value) AS m, stddev_samp(value) AS s FROM obs GROUP BY 1)
    SELECT event_id, o.variable, value, round((value - m) / s, 6) AS z, round(m - 3 * s, 6) AS lower, round(m + 3 * s, 6) AS upper
    FROM obs o JOIN b ON o.variable = b.variable WHERE value < m - 3 * s OR value > m + 3 * s"""))
def _(t):
    out = op.anomalies_z(t.observations, ["variable"], "value", 3.0)
    return out.select(
        "event_id", "variable", "value", F.round("z", 6).alias("z"), F.round("lower", 6).alias("lower"),
        F.round("upper", 6).alias("upper"),
    )


@query("ts_anomaly_z_global", sql_with("obs", """, b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM obs)
    SELECT event_id, value, round((value - m) / s, 6) AS z FROM obs, b WHERE abs(value - m) > 2 * s"""))
def _(t):
    out = op.anomalies_z(t.observations, [], "value", 2.0)
    return out.select("event_id", "value", F.round("z", 6).alias("z"))


@query("ts_anomaly_summary", sql_with("obs", """, b AS (SELECT variable, avg(value) AS m, stddev_samp(value) AS s FROM obs GROUP BY 1)
    SELECT o.variable, count(*) AS total_points, count(*) FILTER (value < m - 3 * s OR value > m + 3 * s) AS anomaly_count,
      round(count(*) FILTER (value < m - 3 * s OR value > m + 3 * s) / count(*), 6) AS anomaly_rate,
      round(max(m + 3 * s), 6) AS upper, round(max(m - 3 * s), 6) AS lower
    FROM obs o JOIN b ON o.variable = b.variable GROUP BY 1"""))
def _(t):
    out = op.anomaly_summary(t.observations, ["variable"], "value", 0)
    return out.select(
        "variable", "total_points", "anomaly_count", *[F.round(c, 6).alias(c) for c in ("anomaly_rate", "upper", "lower")]
    )


@query("ts_anomaly_iqr", sql_with("obs", """, q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM obs GROUP BY 1)
    SELECT event_id, o.variable, value FROM obs o JOIN q ON o.variable = q.variable
    WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""))
def _(t):
    return op.anomalies_iqr(t.observations, ["variable"], "value").select("event_id", "variable", "value")


@query("ts_rolling", sql_with("gappy", """, s AS (SELECT variable, ts, value * 0.7310585 AS value FROM gappy) SELECT variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(avg(value) OVER w, 6) AS value_mean,
    round(stddev_samp(value) OVER w, 6) AS value_std, round(min(value) OVER w, 6) AS value_min, round(max(value) OVER w, 6) AS value_max,
    round(sum(value) OVER w, 6) AS value_sum, round(median(value) OVER w, 6) AS value_median, round(var_samp(value) OVER w, 6) AS value_var,
    count(value) OVER w AS value_count
    FROM s WINDOW w AS (PARTITION BY variable ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""))
def _(t):
    names = ("mean", "std", "min", "max", "sum", "median", "var", "count")
    scaled = t.gappy.withColumn("value", F.col("value") * 0.7310585)
    out = op.rolling(scaled, ["variable"], [F.col("ts")], "value", 24, names)
    return out.select(
        "variable", text_ts("ts").alias("ts"), "value_count",
        *[F.round(f"value_{n}", 6).alias(f"value_{n}") for n in names if n != "count"],
    )


@query("ts_change", sql_with("gappy", """, p AS (SELECT variable, ts, value, last_value(value IGNORE NULLS) OVER
        (PARTITION BY variable ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad FROM gappy)
    SELECT variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(pad / nullif(lag(pad, 1) OVER w, 0) - 1, 6) AS pct_change,
      round(value - lag(value, 1) OVER w, 6) AS diff FROM p WINDOW w AS (PARTITION BY variable ORDER BY ts)"""))
def _(t):
    out = op.change(t.gappy, ["variable"], [F.col("ts")], "value", 1)
    return out.select(
        "variable", text_ts("ts").alias("ts"), F.round("pct_change", 6).alias("pct_change"), F.round("diff", 6).alias("diff")
    )


FILL_SQL = """, r AS (SELECT variable, epoch_us(ts) AS us, value FROM gappy),
    d AS (SELECT variable, us - lag(us) OVER (PARTITION BY variable ORDER BY us) AS delta FROM r),
    g AS (SELECT a.variable, a.f, a.l, CAST(floor(b.step) AS BIGINT) AS step FROM
        (SELECT variable, min(us) AS f, max(us) AS l FROM r GROUP BY 1) a JOIN (SELECT variable, median(delta) AS step FROM d GROUP BY 1) b USING (variable)),
    s AS (SELECT variable, step, f + i * step AS us, i FROM (SELECT variable, step, f, unnest(range(0, (l - f) // step + 1)) AS i FROM g)),
    j AS (SELECT s.variable, s.us, s.i, s.step, r.value FROM s LEFT JOIN r ON s.variable = r.variable AND s.us = r.us),
    k AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS ki FROM j),
    n AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS pv, last_value(ki IGNORE NULLS) OVER a AS pi,
        first_value(value IGNORE NULLS) OVER z AS nv, first_value(ki IGNORE NULLS) OVER z AS ni FROM k
        WINDOW a AS (PARTITION BY variable ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               z AS (PARTITION BY variable ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT variable, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(value, CASE WHEN i - pi <= 10800000000 // step THEN
      CASE WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) / (ni - pi) * (i - pi) END END), 6) AS value FROM n"""


@query("ts_fill_gaps", sql_with("gappy", FILL_SQL))
def _(t):
    filled, _ = op.fill_gaps(t.gappy, ["variable"], "value", 3 * 3600)
    return filled.select("variable", text_ts("ts").alias("ts"), F.round("value", 6).alias("value"))


INTERPOLATE_SQL = """, j AS (SELECT variable, ts, value, row_number() OVER (PARTITION BY variable ORDER BY ts) AS i FROM gappy),
    k AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS ki FROM j),
    n AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS pv, last_value(ki IGNORE NULLS) OVER a AS pi,
        first_value(value IGNORE NULLS) OVER z AS nv, first_value(ki IGNORE NULLS) OVER z AS ni FROM k
        WINDOW a AS (PARTITION BY variable ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               z AS (PARTITION BY variable ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(value, CASE WHEN i - pi <= 5 THEN
      CASE WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) / (ni - pi) * (i - pi) END END), 6) AS value FROM n"""


@query("interpolate", sql_with("gappy", INTERPOLATE_SQL))
def _(t):
    out = op.interpolate(t.gappy, ["variable"], [F.col("ts")], "value", 5)
    return out.select("variable", text_ts("ts").alias("ts"), F.round("value", 6).alias("value"))


@query("dedupe_keep", """WITH c AS (SELECT user_id, event_type, count(*) AS n, arg_min(event_id, row(ts, event_id)) AS f,
    arg_max(event_id, row(ts, event_id)) AS l FROM events GROUP BY 1, 2)
    SELECT 'first' AS kept, user_id, event_type, f AS event_id FROM c
    UNION ALL SELECT 'last', user_id, event_type, l FROM c UNION ALL SELECT 'none', user_id, event_type, f FROM c WHERE n = 1""")
def _(t):
    out = None
    for keep, name in (("first", "first"), ("last", "last"), (False, "none")):
        part = op.dedupe_keep(t.events, ["user_id", "event_type"], ["ts", "event_id"], keep).select(
            F.lit(name).alias("kept"), "user_id", "event_type", "event_id"
        )
        out = part if out is None else out.unionByName(part)
    return out
