"""Queries through user-supplied Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldloom.operators import callables as op
from fieldloom.operators.mergeable import Aggregate, aggregate, fit_apply
from fieldloom.plans.aggregates import GINI_SQL, rounded
from fieldloom.plans.registry import query
from fieldloom.plans.scalars import TILE_SQL
from fieldloom.plans.tables import sql_with


@query("udf_transform", "SELECT event_type, round(sum(value * 2), 4) AS total FROM events WHERE value > 10 GROUP BY 1")
def _(t):
    out = op.chain(
        t.events, lambda df: df.where("value > 10"), lambda df: df.withColumn("double", F.col("value") * 2),
        lambda df: df.groupBy("event_type").agg(F.sum("double").alias("total")),
    )
    return rounded(out, 4, "total")


@query("udf_scalar", sql_with("points", f", t AS (SELECT id, {TILE_SQL.format(n=512)} FROM points) SELECT id, '9/' || x || '/' || y AS cell FROM t"))
def _(t):
    def cell(lon: pd.Series, lat: pd.Series) -> pd.Series:
        n = 512
        phi = np.radians(lat.clip(-85.0511287798066, 85.0511287798066))
        x = np.clip(np.floor((lon + 180.0) / 360.0 * n), 0, n - 1).astype(int)
        y = np.clip(np.floor((1.0 - np.log(np.tan(phi) + 1.0 / np.cos(phi)) / np.pi) / 2.0 * n), 0, n - 1).astype(int)
        return "9/" + x.astype(str) + "/" + y.astype(str)

    return t.points.select("id", op.scalar(cell, "string")(F.col("lon"), F.col("lat")).alias("cell"))


def _line(x: str, y: str, *after: str) -> Aggregate:
    """A least-squares line through (x, y) from mergeable moments about the mean, by pairwise updates."""

    def update(state, rows: pd.DataFrame):
        u, v = rows[x].to_numpy(float), rows[y].to_numpy(float)
        mu, mv = u.mean(), v.mean()
        return merge(state, (len(u), mu, mv, float(((u - mu) ** 2).sum()), float(((u - mu) * (v - mv)).sum())))

    def merge(a, b):
        n = a[0] + b[0]
        if not n:
            return a
        du, dv, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
        return n, a[1] + du * b[0] / n, a[2] + dv * b[0] / n, a[3] + b[3] + du * du * w, a[4] + b[4] + du * dv * w

    def finish(s):
        slope = s[4] / s[3] if s[3] else None
        full = {"slope": slope, "n": s[0], "at": s[1], "level": s[2]}
        return [full[c] for c in after]

    return Aggregate(lambda: (0, 0.0, 0.0, 0.0, 0.0), update, merge, finish)


#: a third of all rows has one key
CROWDED = "CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END"


@query("udf_grouped", f"""WITH o AS (SELECT {CROWDED} AS place, event_id, value FROM events),
    f AS (SELECT place, regr_slope(value, event_id) AS s, avg(event_id) AS a, avg(value) AS l FROM o GROUP BY 1)
    SELECT event_id, round(value - coalesce(l + s * (event_id - a), l), 4) AS residual FROM o JOIN f ON o.place IS NOT DISTINCT FROM f.place""")
def _(t):
    rows = t.events.select(F.expr(CROWDED).alias("place"), "event_id", "value")

    def residuals(key: tuple, line: tuple, part: pd.DataFrame) -> pd.DataFrame:
        slope, at, level = line
        expected = level + (0.0 if slope is None or np.isnan(slope) else slope) * (part["event_id"] - at)
        return pd.DataFrame({"event_id": part["event_id"], "residual": part["value"] - expected})

    agg = _line("event_id", "value", "slope", "at", "level")
    out = fit_apply(rows, ["place"], ["event_id", "value"], agg, "slope double, at double, level double", residuals, "event_id long, residual double")
    return rounded(out, 4, "residual")


@query("udf_grouped_fit", sql_with("obs", "SELECT station, round(regr_slope(value, event_id), 6) AS slope, count(*) AS n FROM obs GROUP BY 1"))
def _(t):
    out = aggregate(t.observations, ["station"], ["event_id", "value"], _line("event_id", "value", "slope", "n"), "slope double, n long")
    return rounded(out, 6, "slope")


def _gini(value: str) -> Aggregate:
    """Gini of ordered values: (rows, sum, sum of rank times value) of a range; a higher range's ranks move by the rows below."""

    def update(state, rows: pd.DataFrame):
        x = rows[value].to_numpy(float)
        return merge(state, (len(x), float(x.sum()), float((np.arange(1, len(x) + 1) * x).sum())))

    def merge(a, b):
        return a[0] + b[0], a[1] + b[1], a[2] + b[2] + a[0] * b[1]

    def finish(s):
        return [2 * s[2] / (s[0] * s[1]) - (s[0] + 1) / s[0] if s[1] else 0.0]

    return Aggregate(lambda: (0, 0.0, 0.0), update, merge, finish)


@query("udf_agg", GINI_SQL.format(k="event_type", x="value", t="events").replace(", count(*) AS n", ""))
def _(t):
    return rounded(aggregate(t.events, ["event_type"], ["value"], _gini("value"), "gini double", ["value"]), 6, "gini")


@query("udf_agg_crowded", GINI_SQL.format(k="place", x="value", t=f"(SELECT {CROWDED} AS place, value FROM events)").replace(", count(*) AS n", ""))
def _(t):
    rows = t.events.select(F.expr(CROWDED).alias("place"), "value")
    return rounded(aggregate(rows, ["place"], ["value"], _gini("value"), "gini double", ["value"]), 6, "gini")


@query("udtf_tiles", sql_with("points", f""", a AS (SELECT id, {TILE_SQL.format(n=32)} FROM points),
    b AS (SELECT id, {TILE_SQL.format(n=32)} FROM (SELECT id, least(lon + 7, 180) AS lon, greatest(lat - 5, -90) AS lat FROM points))
    SELECT id, '5/' || i || '/' || j AS tile FROM (SELECT id, i, unnest(range(y0, y1 + 1)) AS j FROM
      (SELECT a.id, unnest(range(a.x, b.x + 1)) AS i, a.y AS y0, b.y AS y1 FROM a JOIN b ON a.id = b.id))"""))
def _(t):
    name = op.register_tiles(t.spark)
    t.points.createOrReplaceTempView("points_for_tiles")
    return t.spark.sql(
        f"SELECT id, tile FROM points_for_tiles, LATERAL {name}(lon, greatest(lat - 5, -90.0D), least(lon + 7, 180.0D), lat, 5)"
    )


@query("ml_batch_score", "SELECT l_orderkey * 10 + l_linenumber AS row_id, round(sum(l_quantity * 2 + l_discount * 100 - l_tax), 4) AS y_pred FROM lineitem GROUP BY 1")
def _(t):
    def load():
        weights = np.array([2.0, 100.0, -1.0])
        return lambda x: x @ weights

    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_quantity", "l_discount", "l_tax")
    scored = op.batch_score(rows, "row_id", ["l_quantity", "l_discount", "l_tax"], load)
    return rounded(scored.groupBy("row_id").agg(F.sum("y_pred").alias("y_pred")), 4, "y_pred")
