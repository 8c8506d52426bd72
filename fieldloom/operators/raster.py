"""Rasters as pixel rows (raster_id, band, row, col, value)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geo import tile_of
from fieldloom.functions.scalar import normalised_difference
from fieldloom.operators.aggregates import histogram, share_of_total
from fieldloom.operators.scale import quantiles, same_keys


@dataclass(frozen=True)
class Affine:
    """x = a·col + b·row + c, y = d·col + e·row + f."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def centre(self) -> tuple[Column, Column]:
        col, row = F.col("col") + 0.5, F.col("row") + 0.5
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f


PIXEL = ["raster_id", "row", "col"]


def mask_nodata(df: DataFrame, nodata: float) -> DataFrame:
    """Nodata and NaN become null."""
    v = F.col("value")
    return df.withColumn("value", F.when((v != nodata) & ~F.isnan(v), v))


def ndvi(df: DataFrame, red: int = 3, nir: int = 4) -> DataFrame:
    """Vegetation index per pixel from two bands, by one conditional aggregate per pixel."""
    bands = df.where(F.col("band").isin(red, nir)).groupBy(*PIXEL).agg(
        F.max(F.when(F.col("band") == red, F.col("value"))).alias("_red"), F.max(F.when(F.col("band") == nir, F.col("value"))).alias("_nir")
    )
    return bands.select(*PIXEL, normalised_difference(F.col("_nir"), F.col("_red")).alias("ndvi"))


def clip(df: DataFrame, affine: Affine, bbox: Sequence[float], fill: float | None) -> DataFrame:
    """Pixels whose centre lies outside the box get ``fill``."""
    x, y = affine.centre()
    w, s, e, n = bbox
    inside = x.between(w, e) & y.between(s, n)
    return df.withColumn("value", F.when(inside, F.col("value")).otherwise(F.lit(fill)))


def stats(df: DataFrame, nodata: float, hot_rows: int | None = None) -> DataFrame:
    """Per raster and band: min, max, mean, population std, median, valid and nodata counts."""
    masked = mask_nodata(df, nodata)
    keys = ["raster_id", "band"]
    base = masked.groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count("value").alias("valid"), F.count_if(F.col("value").isNull()).alias("nodata"),
    )
    return same_keys(base, quantiles(masked, keys, "value", {"median": 0.5}, hot_rows), keys, "left")


def band_histogram(df: DataFrame, nodata: float, bins: int = 50) -> DataFrame:
    return histogram(mask_nodata(df, nodata), ["raster_id", "band"], "value", bins)


def downsample(df: DataFrame, factor: int) -> DataFrame:
    """Mean of factor × factor blocks; null pixels are left out of their block."""
    return df.groupBy(
        "raster_id", "band", F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")
    ).agg(F.avg("value").alias("value"))


def resize_bilinear(df: DataFrame, rows: int, cols: int, new_rows: int, new_cols: int) -> DataFrame:
    """Bilinear resize with aligned corners.

    Each pixel is sent to the target pixels it weighs in (at most those within
    one source pixel), which then sum weight times value: one shuffle, no
    neighbour join.
    """
    ry = (rows - 1) / max(new_rows - 1, 1)
    rx = (cols - 1) / max(new_cols - 1, 1)

    def targets(at: str, ratio: float, size: int) -> Column:
        if ratio == 0:
            return F.when(F.col(at) == 0, F.sequence(F.lit(0), F.lit(size - 1)))
        low, high = F.ceil((F.col(at) - 1) / ratio), F.floor((F.col(at) + 1) / ratio)
        low, high = F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(size - 1)).cast("int")
        return F.when(low <= high, F.sequence(low, high))

    spread = df.withColumn("_r", F.explode(targets("row", ry, new_rows))).withColumn("_c", F.explode(targets("col", rx, new_cols)))
    wr = 1 - F.abs(F.col("_r") * ry - F.col("row"))
    wc = 1 - F.abs(F.col("_c") * rx - F.col("col"))
    weight = F.greatest(wr, F.lit(0.0)) * F.greatest(wc, F.lit(0.0))
    weighed = spread.withColumn("_w", weight).where("_w > 0")
    return weighed.groupBy("raster_id", "band", F.col("_r").alias("row"), F.col("_c").alias("col")).agg(
        F.try_divide(F.sum(F.col("_w") * F.col("value")), F.sum(F.when(F.col("value").isNotNull(), F.col("_w")))).alias("value")
    )


def zonal(df: DataFrame, affine: Affine, zoom: int) -> DataFrame:
    """Statistics of the pixels of each map tile."""
    x, y = affine.centre()
    return df.groupBy("raster_id", "band", tile_of(x, y, zoom).alias("tile")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def class_shares(df: DataFrame, region: Sequence[str]) -> DataFrame:
    """Share of each class value in a region."""
    one = df.where(F.col("value").isNotNull()).withColumn("class", F.col("value").cast("int")).withColumn("_one", F.lit(1))
    return share_of_total(one, region, ["class"], "_one").select(*region, "class", F.col("amount").alias("pixels"), "percentage")
