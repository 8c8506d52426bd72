"""Raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import raster as op
from fieldloom.plans.aggregates import rounded
from fieldloom.plans.registry import query
from fieldloom.plans.scalars import TILE_SQL
from fieldloom.plans.tables import sql_with

GRID = op.Affine(0.5, 0.0, -20.0, 0.0, -0.25, 40.0)
XY = "(col + 0.5) * 0.5 - 20 AS lon, (\"row\" + 0.5) * -0.25 + 40 AS lat"


@query("ra_mask_nodata", sql_with("pixels", 'SELECT raster_id, band, "row", col, nullif(value, -9999) AS value FROM pixels'))
def _(t):
    return op.mask_nodata(t.pixels, -9999.0)


@query("ra_ndvi", sql_with("pixels", """, b AS (SELECT raster_id, "row", col, max(CASE WHEN band = 3 THEN value END) AS r, max(CASE WHEN band = 4 THEN value END) AS n FROM pixels WHERE value <> -9999 GROUP BY 1, 2, 3)
    SELECT raster_id, "row", col, round(CASE WHEN n + r = 0 THEN 0 WHEN n IS NULL OR r IS NULL THEN NULL ELSE greatest(-1, least(1, (n - r) / (n + r))) END, 6) AS ndvi FROM b"""))
def _(t):
    return rounded(op.ndvi(op.mask_nodata(t.pixels, -9999.0)), 6, "ndvi")


@query("ra_clip", sql_with("pixels", f"""SELECT raster_id, band, "row", col, CASE WHEN lon BETWEEN -10 AND 10 AND lat BETWEEN 30 AND 38 THEN value END AS value
    FROM (SELECT *, {XY} FROM pixels)"""))
def _(t):
    return op.clip(t.pixels, GRID, (-10.0, 30.0, 10.0, 38.0), None)


@query("ra_stats", sql_with("pixels", """, m AS (SELECT raster_id, band, nullif(value, -9999) AS v FROM pixels)
    SELECT raster_id, band, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, count(v) AS valid, count(*) - count(v) AS nodata FROM m GROUP BY 1, 2"""))
def _(t):
    return rounded(op.stats(t.pixels, -9999.0), 6, "mean", "std", "median")


@query("ra_histogram", sql_with("pixels", """, m AS (SELECT raster_id, band, nullif(value, -9999) AS v FROM pixels), s AS (SELECT raster_id, band, min(v) AS lo, max(v) AS hi FROM m GROUP BY 1, 2),
    c AS (SELECT m.raster_id, m.band, least(floor((v - lo) / (hi - lo) * 50), 49) AS bin, count(*) AS n FROM m JOIN s ON m.raster_id = s.raster_id AND m.band = s.band WHERE v IS NOT NULL GROUP BY 1, 2, 3)
    SELECT s.raster_id, s.band, CAST(b.bin AS BIGINT) AS bin, coalesce(n, 0) AS n FROM s CROSS JOIN (SELECT unnest(range(50)) AS bin) b LEFT JOIN c ON c.raster_id = s.raster_id AND c.band = s.band AND c.bin = b.bin"""))
def _(t):
    return op.band_histogram(t.pixels, -9999.0, 50)


@query("ra_downsample", sql_with("pixels", """SELECT raster_id, band, "row" // 4 AS "row", col // 4 AS col, round(avg(nullif(value, -9999)), 6) AS value FROM pixels GROUP BY 1, 2, 3, 4"""))
def _(t):
    return rounded(op.downsample(op.mask_nodata(t.pixels, -9999.0), 4), 6, "value")


@query("ra_resize_bilinear", sql_with("pixels", """, p AS (SELECT raster_id, band, "row" AS r, col AS c, nullif(value, -9999) AS v FROM pixels),
    g AS (SELECT i, j FROM (SELECT unnest(range(65)) AS i) CROSS JOIN (SELECT unnest(range(150)) AS j)),
    w AS (SELECT raster_id, band, i, j, v, greatest(1 - abs(i * (99 / 64) - r), 0) * greatest(1 - abs(j * (99 / 149) - c), 0) AS w FROM p JOIN g ON abs(i * (99 / 64) - r) < 1 AND abs(j * (99 / 149) - c) < 1)
    SELECT raster_id, band, i AS "row", j AS col, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 4) AS value FROM w WHERE w > 0 GROUP BY 1, 2, 3, 4"""))
def _(t):
    out = op.resize_bilinear(op.mask_nodata(t.pixels, -9999.0), 100, 100, 65, 150)
    return out.select("raster_id", "band", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("value", 4).alias("value"))


@query("ra_zonal", sql_with("pixels", f""", p AS (SELECT raster_id, band, value, {XY} FROM pixels), t AS (SELECT raster_id, band, value, {TILE_SQL.format(n=64)} FROM p)
    SELECT raster_id, band, '6/' || x || '/' || y AS tile, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM t GROUP BY 1, 2, 3"""))
def _(t):
    return rounded(op.zonal(t.pixels, GRID, 6), 6, "mean")


@query("ra_classes", sql_with("pixels", """, c AS (SELECT raster_id, "row" // 10 AS zone, CAST(value AS INT) % 10 AS class, count(*) AS pixels FROM pixels WHERE band = 3 GROUP BY 1, 2, 3)
    SELECT raster_id, zone, class, pixels, round(pixels / sum(pixels) OVER (PARTITION BY raster_id, zone) * 100, 6) AS percentage FROM c"""))
def _(t):
    land = t.pixels.where("band = 3").select("raster_id", F.floor(F.col("row") / 10).alias("zone"), (F.col("value").cast("int") % 10).alias("value"))
    return rounded(op.class_shares(land, ["raster_id", "zone"]), 6, "percentage")
