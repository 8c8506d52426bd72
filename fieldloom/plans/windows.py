"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import windows as op
from fieldloom.operators.filters import filter_time
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with, text_ts


@query("win_samples", sql_with("gappy", """, v AS (SELECT * FROM gappy WHERE value IS NOT NULL), s AS (SELECT variable, ts,
    list(value) OVER (PARTITION BY variable ORDER BY ts ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS a,
    list(value) OVER (PARTITION BY variable ORDER BY ts ROWS BETWEEN 12 FOLLOWING AND 14 FOLLOWING) AS b FROM v)
    SELECT variable, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(list_sum(a), 4) AS input_sum, round(a[1], 6) AS first_input,
      round(a[12], 6) AS last_input, round(list_sum(b), 4) AS target_sum FROM s WHERE len(a) = 12 AND len(b) = 3"""))
def _(t):
    out = op.training_samples(t.gappy, ["variable"], [F.col("ts")], "value", 12, 3)

    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v), 4)

    return out.select(
        "variable", text_ts("ts").alias("ts"), total("inputs").alias("input_sum"),
        F.round(F.element_at("inputs", 1), 6).alias("first_input"), F.round(F.element_at("inputs", -1), 6).alias("last_input"),
        total("targets").alias("target_sum"),
    )


@query("win_last_n", """SELECT conv_id, turn, role FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def _(t):
    return op.last_n(t.conversations, ["conv_id"], ["turn"], 3).select("conv_id", "turn", "role")


@query("win_history", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role, md5(text) AS digest FROM conversations""")
def _(t):
    out = op.history(t.conversations, ["conv_id"], [F.col("turn")])
    return out.select("conv_id", "place", "role", F.md5("text").alias("digest"))


@query("win_ttl", """SELECT user_id, arg_max(event_type, row(ts, event_id)) AS event_type, count(*) AS live FROM events
    WHERE event_type = 'click' OR ts + to_seconds(CAST(user_id * 3600 AS BIGINT)) >= TIMESTAMP '2024-01-20' GROUP BY 1""")
def _(t):
    entries = t.events.withColumn(
        "expires_at",
        F.when(F.col("event_type") != "click", F.timestamp_micros(F.unix_micros("ts") + F.col("user_id") * 3_600_000_000)),
    )
    at = F.lit("2024-01-20").cast("timestamp")
    return op.live_latest(entries, "user_id", "event_type", ["ts", "event_id"], "expires_at", at)


@query("win_smooth", sql_with("episodes", """SELECT policy, event_id, round(avg(reward) OVER w, 6) AS smoothed FROM episodes
    WINDOW w AS (PARTITION BY policy ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 20"""))
def _(t):
    out = op.smooth(t.episodes, ["policy"], [F.col("ts"), F.col("event_id")], "reward", 20)
    return out.select("policy", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query("win_rank", sql_with("episodes", """SELECT policy, round(m, 6) AS mean_score, row_number() OVER (ORDER BY m DESC, policy) AS place
    FROM (SELECT policy, avg(reward) AS m FROM episodes GROUP BY 1)"""))
def _(t):
    out = op.ranking(t.episodes, "policy", "reward")
    return out.select("policy", F.round("mean_score", 6).alias("mean_score"), "place")


@query("win_lags", sql_with("obs", """SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2,
    lag(value, 3) OVER w AS value_lag3 FROM obs WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)"""))
def _(t):
    out = op.lags(t.observations, ["station"], [F.col("ts"), F.col("event_id")], ["value"], 3)
    return out.select("event_id", "value_lag1", "value_lag2", "value_lag3")


@query("win_sessions", sql_with("obs", """, m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY station ORDER BY ts, event_id)
      > 21600000000 THEN 1 WHEN lag(ts) OVER (PARTITION BY station ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM obs),
    s AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
    SELECT station, CAST(session AS BIGINT) AS session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_ts,
      count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY station, session"""))
def _(t):
    out = op.sessions(t.observations, ["station"], "ts", "event_id", 6 * 3600)
    return out.groupBy("station", "session").agg(
        text_ts(F.min("ts")).alias("start_ts"), text_ts(F.max("ts")).alias("end_ts"), F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 2).alias("total"),
    )


@query("win_temporal_evolution", sql_with("obs", """SELECT station, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, variable, value,
    row_number() OVER (PARTITION BY station ORDER BY ts, event_id) AS place FROM obs
    WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15'"""))
def _(t):
    rows = filter_time(t.observations, "2024-01-05", "2024-01-15")
    out = op.history(rows, ["station"], [F.col("ts"), F.col("event_id")])
    return out.select("station", text_ts("ts").alias("ts"), "variable", "value", "place")
