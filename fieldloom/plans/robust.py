"""Robust aggregation and privacy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import robust as op
from fieldloom.plans.aggregates import rounded
from fieldloom.plans.registry import query
from fieldloom.plans.tables import sql_with


@query("fl_weighted_mean", sql_with("updates", "SELECT idx, round(sum(num_samples * value) / sum(num_samples), 6) AS value FROM updates GROUP BY 1"))
def _(t):
    return rounded(op.weighted_mean(t.updates, ["idx"]), 6, "value")


@query("fl_median", "SELECT user_id % 20 AS idx, quantile_disc(value, 0.5) AS value FROM events GROUP BY 1")
def _(t):
    return op.median(t.events.select((F.col("user_id") % 20).alias("idx"), "value"), ["idx"])


@query("fl_trimmed_mean", """WITH r AS (SELECT user_id % 20 AS idx, value, row_number() OVER (PARTITION BY user_id % 20 ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id % 20) AS n FROM events)
    SELECT idx, round(avg(value), 6) AS value FROM r WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY 1""")
def _(t):
    return rounded(op.trimmed_mean(t.events.select((F.col("user_id") % 20).alias("idx"), "value"), ["idx"], 0.1), 6, "value")


@query("fl_round_metrics", """SELECT round, count(*) AS participants, round(avg(l), 6) AS mean_loss FROM (SELECT CAST(floor(event_id / 100) AS BIGINT) AS round, user_id, avg(value) AS l FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    rows = t.events.select(F.floor(F.col("event_id") / 100).alias("round"), "user_id", "value")
    return rounded(op.round_metrics(rows, "round", "user_id", "value"), 6, "mean_loss")


CLIP_SQL = """WITH n AS (SELECT user_id, sqrt(sum(value * value)) AS norm FROM events GROUP BY 1)
    SELECT event_type, round(sum(value * least(1, 100 / norm)), 6) AS clipped_sum FROM events e JOIN n ON e.user_id = n.user_id GROUP BY 1"""


@query("dp_clipped_sum", CLIP_SQL)
def _(t):
    out = op.clip_to_norm(t.events, "user_id", "value", 100.0).groupBy("event_type").agg(F.sum("value").alias("clipped_sum"))
    return rounded(out, 6, "clipped_sum")


@query("dp_gaussian", CLIP_SQL.replace("AS clipped_sum", "AS clipped_sum, true AS noisy"))
def _(t):
    out = op.private_sums(t.events, "user_id", "event_type", "value", 100.0, 1.0, 1e-5, seed=7)
    return out.select("event_type", F.round("clipped_sum", 6).alias("clipped_sum"), (F.abs(F.col("noisy_sum") - F.col("clipped_sum")) > 0).alias("noisy"))


@query("dp_accountant", """WITH o AS (SELECT 1 + x / 10.0::DOUBLE AS a FROM (SELECT unnest(range(1, 100)) AS x) UNION ALL SELECT CAST(x AS DOUBLE) FROM (SELECT unnest(range(12, 64)) AS x)),
    r AS (SELECT event_type, 5 + user_id % 10 AS s, CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS q FROM events),
    c AS (SELECT event_type, a, sum(CASE WHEN q >= 1 THEN a / (2.0 * s * s) ELSE ln(1 + q * q * a * (a - 1) / (2.0 * s * s)) / (a - 1) END) AS rdp, count(*) AS n FROM r CROSS JOIN o GROUP BY 1, 2)
    SELECT event_type, max(n) AS rounds, round(min(rdp + ln(1 / 1e-5) / (a - 1)), 6) AS epsilon, min(rdp + ln(1 / 1e-5) / (a - 1)) <= 40 AS within_budget FROM c GROUP BY 1""")
def _(t):
    rounds = t.events.select("event_type", (5 + F.col("user_id") % 10).alias("sigma"), F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.1).alias("rate"))
    return rounded(op.privacy_spent(rounds, ["event_type"], "sigma", "rate", 1e-5, 40.0), 6, "epsilon")
