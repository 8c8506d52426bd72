"""Streaming queries: the events table is replayed as a stream and compared with the same rows in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom.plans.registry import query
from fieldloom.plans.tables import BASE, sql_with, text_ts
from fieldloom.session import shared_dir
from fieldloom.streaming import flows

MAX_TS = "(SELECT max(ts) FROM events)"


def _stream(t):
    return flows.read_events(t.spark, t.dir, BASE["events"], glob="events.parquet")


def _observations(t):
    return _stream(t).select("event_id", F.col("event_type").alias("variable"), "value", "ts", F.col("user_id").alias("station"))


def _name(kind: str) -> str:
    return f"stream-{kind}-{uuid.uuid4().hex}"


@query("st_ingest", "SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE event_id % 40 <> 0")
def _(t):
    body = F.to_json(F.struct("event_id", "event_type", "ts", F.lit("sensor").alias("source"), "value"))
    raw = _stream(t).select(F.when(F.col("event_id") % 40 == 0, "{broken").otherwise(body).alias("value"))
    table, _ = flows.run_to_table(flows.good_envelopes(flows.parse_envelopes(raw)), _name("ingest"))
    return table.select("event_id", "event_type", "value", text_ts("ts").alias("ts"))


@query("st_dedupe", "SELECT event_id, event_type, value FROM events")
def _(t):
    copies = F.when(F.col("event_id") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    doubled = _stream(t).select("event_id", "event_type", "value", "ts", F.explode(copies).alias("copy"))
    table, _ = flows.run_to_table(flows.dedupe(doubled), _name("dedupe"))
    return table.select("event_id", "event_type", "value")


@query("st_tumbling", f"""WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type AS variable, avg(value) AS a, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start_ts, variable, round(a, 6) AS avg_value, lo AS min_value, hi AS max_value, n FROM w WHERE s + INTERVAL 1 HOUR <= {MAX_TS} - INTERVAL 1 HOUR""")
def _(t):
    table, _ = flows.run_to_table(flows.tumbling(_observations(t), ["variable"], "value", "1 hour"), _name("tumbling"))
    return table.select(text_ts("start_ts").alias("start_ts"), "variable", F.round("avg_value", 6).alias("avg_value"), "min_value", "max_value", "n")


@query("st_sliding", f"""WITH s AS (SELECT event_type AS variable, value, unnest([date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 2 AS INT)) - to_hours(2 * i) for i in [0, 1, 2]]) AS s FROM events),
    w AS (SELECT s, variable, avg(value) AS a, stddev_samp(value) AS d, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start_ts, variable, round(a, 6) AS avg_value, round(d, 6) AS std_value, n FROM w WHERE s + INTERVAL 6 HOUR <= {MAX_TS} - INTERVAL 1 HOUR""")
def _(t):
    table, _ = flows.run_to_table(flows.sliding(_observations(t), ["variable"], "value", "6 hours", "2 hours"), _name("sliding"))
    return table.select(
        text_ts("start_ts").alias("start_ts"), "variable", F.round("avg_value", 6).alias("avg_value"), F.round("std_value", 6).alias("std_value"), "n"
    )


@query("st_session", sql_with("obs", f""", m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM obs),
    s AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m),
    g AS (SELECT station, min(ts) AS a, max(ts) AS b, count(*) AS n, sum(value) AS total FROM s GROUP BY station, k)
    SELECT station, strftime(a, '%Y-%m-%d %H:%M:%S') AS start_ts, n, round(total, 2) AS total FROM g WHERE b + INTERVAL 6 HOUR <= {MAX_TS} - INTERVAL 1 HOUR"""))
def _(t):
    table, _ = flows.run_to_table(flows.sessions(_observations(t), ["station"], "value", "6 hours"), _name("session"))
    return table.select("station", text_ts("start_ts").alias("start_ts"), "n", F.round("total", 2).alias("total"))


RUNNING = """, r AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM obs WINDOW w AS (PARTITION BY variable ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT event_id, variable, ts, value, m AS baseline, (value - m) / s AS score, CASE WHEN abs((value - m) / s) >= 4 THEN 'critical' WHEN abs((value - m) / s) >= 3 THEN 'high' ELSE 'medium' END AS severity
      FROM r WHERE n >= 10 AND abs((value - m) / s) > 3)"""


def _anomalies(t, name: str):
    path = f"{shared_dir(t.spark)}/{name}"
    sink = flows.anomaly_sink(path, "variable STRING", ["variable"], "value", ["ts", "event_id"], centre=40.0)
    flows.run_batches(_observations(t), name, sink)
    return t.spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out").drop("batch")


@query("st_anomaly", sql_with("obs", RUNNING + " SELECT event_id, variable, round(baseline * 0.7310585, 6) AS scaled_baseline, round(score, 5) AS score, severity FROM f"))
def _(t):
    out = _anomalies(t, _name("anomaly"))
    return out.select("event_id", "variable", F.round(F.col("baseline") * 0.7310585, 6).alias("scaled_baseline"), F.round("score", 5).alias("score"), "severity")


@query("st_alerts", sql_with("obs", RUNNING + """ SELECT 'alert-' || event_id AS alert_id, variable, severity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from,
    strftime(to_timestamp(floor(epoch(ts)) + length(variable) * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS valid_until FROM f WHERE abs(score) >= 3 + length(variable) / 10"""))
def _(t):
    schema = "alert_id STRING, variable STRING, severity STRING, valid_from TIMESTAMP, valid_until TIMESTAMP, resolved BOOLEAN"
    path = f"{shared_dir(t.spark)}/{_name('alerts')}"
    rules = t.events.select(F.col("event_type").alias("variable")).distinct().select(
        "variable", (3 + F.length("variable") / 10).alias("min_score"), F.length("variable").alias("hours")
    )
    state = flows.anomaly_sink(f"{path}/detect", "variable STRING", ["variable"], "value", ["ts", "event_id"], centre=40.0)
    merge = flows.upsert_sink(f"{path}/table", schema, ["alert_id"], ["severity", "valid_until"], ["valid_from"])

    def each(batch, number):
        state(batch, number)
        found = batch.sparkSession.read.parquet(f"{path}/detect/out/batch={number}")
        merge(flows.alerts(found, rules), number)

    flows.run_batches(_observations(t), _name("alerts-run"), each)
    live = flows.open_alerts(flows.latest(t.spark, f"{path}/table", schema, ["alert_id"], ["valid_from"], ["severity", "valid_until"]))
    return live.select("alert_id", "variable", "severity", text_ts("valid_from").alias("valid_from"), text_ts("valid_until").alias("valid_until"))


@query("st_late", f"""SELECT CAST(count(*) AS BIGINT) AS kept FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {MAX_TS} - INTERVAL 1 HOUR""")
def _(t):
    table, _ = flows.run_to_table(flows.tumbling(_observations(t), ["variable"], "value", "1 hour"), _name("late"))
    return table.agg(F.sum("n").alias("kept"))


@query("st_join_static", sql_with("stations", "SELECT event_id, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, value FROM events JOIN stations ON user_id = station WHERE lat > 0"))
def _(t):
    joined = flows.join_stations(_observations(t), t.stations.where("lat > 0"))
    table, _ = flows.run_to_table(joined.select("event_id", "lon", "lat", "value"), _name("static"))
    return table


@query("st_join", """SELECT a.event_id AS anomaly_id, b.event_id AS reading_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.value > 120 AND b.event_type = 'view'
    AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""")
def _(t):
    e = _observations(t)
    left = e.where("value > 120").select(F.col("event_id").alias("anomaly_id"), "station", F.col("ts").alias("anomaly_ts"))
    right = e.where("variable = 'view'").select(F.col("event_id").alias("reading_id"), "station", F.col("ts").alias("reading_ts"))
    joined = flows.join_in_bound(left, right, "station", "anomaly_ts", "reading_ts", "6 HOURS")
    table, _ = flows.run_to_table(joined.select("anomaly_id", "reading_id"), _name("join"))
    return table


def _replayed(t, name: str, parts, sink) -> str:
    """Run a batch function over a folder where ``parts`` of the events land one after the other, and go on each time
    from the checkpoint; the number of batches that had rows is the number of parts."""
    landing = f"{shared_dir(t.spark)}/{name}-landing"
    for part in parts:
        part.write.mode("append").parquet(landing)
        flows.run_batches(flows.read_events(t.spark, landing, BASE["events"]), name, sink)
    return landing


#: events that arrive with each of five batches, whatever their time: most batches bring rows older than stored ones
ARRIVALS = ["event_id % 7 IN (0, 6)", "event_id % 7 = 3", "event_id % 7 = 1", "event_id % 7 IN (2, 5)", "event_id % 7 = 4"]


@query("st_upsert_sink", "SELECT user_id AS station, arg_max(value, row(ts, event_id)) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events GROUP BY 1")
def _(t):
    schema, keys, order = "station BIGINT, value DOUBLE, ts TIMESTAMP", ["station"], ["ts", "event_id"]
    path = f"{shared_dir(t.spark)}/{_name('upsert')}"
    merge = flows.upsert_sink(path, schema, keys, None, order, max_deltas=2)
    _replayed(t, _name("upsert-run"), [t.events.where(a) for a in ARRIVALS], lambda batch, n: merge(batch.withColumnRenamed("user_id", "station"), n))
    return flows.latest(t.spark, path, schema, keys, order).select("station", "value", text_ts("ts").alias("ts"))


@query("upsert_lookup", """WITH e AS (SELECT *, CASE event_id % 7 WHEN 0 THEN 0 WHEN 6 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 5 THEN 3 WHEN 2 THEN 3 ELSE 4 END AS batch FROM events),
    l AS (SELECT user_id, batch, arg_max(event_type, row(ts, event_id)) AS event_type FROM e GROUP BY 1, 2)
    SELECT user_id AS station, arg_min(l.event_type, l.batch) AS first_type, max(v.value) AS value FROM l
    JOIN (SELECT user_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1) v USING (user_id) WHERE user_id % 11 = 3 GROUP BY 1""")
def _(t):
    """Some keys of a table after five commits: one column keeps what the first commit gave, one follows the newest row."""
    from fieldloom.sources.mergetable import MergeTable

    table = MergeTable(t.spark, f"{shared_dir(t.spark)}/{_name('table')}", "station BIGINT, first_type STRING, value DOUBLE", ["station"], ["ts", "event_id"], ["value"], max_deltas=3)
    rows = t.events.withColumnsRenamed({"user_id": "station", "event_type": "first_type"})
    for arrival in ARRIVALS:
        table.apply(rows.where(arrival))
    return table.lookup(rows.select("station").where("station % 11 = 3"))
