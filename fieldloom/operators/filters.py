"""Predicates, search and paging."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fieldloom.functions.geo import haversine_m

EARTH_DEGREE_M = 111_195.0  # metres of one degree of latitude on the sphere, rounded up


def filter_bbox(df: DataFrame, bbox: Sequence[float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside (min_lon, min_lat, max_lon, max_lat), edges included."""
    min_lon, min_lat, max_lon, max_lat = bbox
    return df.where(F.col(lon).between(min_lon, max_lon) & F.col(lat).between(min_lat, max_lat))


def bbox_valid(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """Inside the lon/lat ranges and not reversed (so no antimeridian crossing)."""
    return (
        min_lon.between(-180, 180) & max_lon.between(-180, 180) & min_lat.between(-90, 90)
        & max_lat.between(-90, 90) & (min_lon <= max_lon) & (min_lat <= max_lat)
    )


def filter_time(df: DataFrame, start: Any = None, end: Any = None, ts: str = "ts") -> DataFrame:
    """start <= ts <= end; either end may be missing."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df


def filter_attrs(
    df: DataFrame, equals: dict[str, Any] | None = None, at_least: dict[str, Any] | None = None,
    at_most: dict[str, Any] | None = None,
) -> DataFrame:
    """Optional predicates; one given as None adds nothing."""
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, value in (at_least or {}).items():
        if value is not None:
            df = df.where(F.col(name) >= value)
    for name, value in (at_most or {}).items():
        if value is not None:
            df = df.where(F.col(name) <= value)
    return df


def search_name(df: DataFrame, text: str, columns: Sequence[str], status: str | None = None, status_col: str = "status"):
    """Case-insensitive substring in any of ``columns``, with an optional status."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return filter_attrs(df.where(hit), {status_col: status})


def filter_entities(df: DataFrame, entities: Sequence[Any] | DataFrame, column: str = "entity") -> DataFrame:
    """Rows of the listed entities (a list, or the first column of a frame): a semi join, whatever their number.

    A list takes the column's own type, so an empty one gives no row and a null in it matches nothing.
    """
    if isinstance(entities, DataFrame):
        wanted = entities.select(F.col(entities.columns[0]).alias(column))
    else:
        wanted = df.sparkSession.createDataFrame([(e,) for e in entities], StructType([StructField(column, df.schema[column].dataType)]))
    return df.join(wanted, column, "left_semi")


def soft_delete(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    """Live rows."""
    return df.where(F.col(column).isNull())


def filter_viewport(
    df: DataFrame, bbox: Sequence[float], newest: str, key: str, limit: int = 200, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Newest ``limit`` rows of a map window (a top-k per partition, then one merge)."""
    return filter_bbox(df, bbox, lon, lat).orderBy(F.desc(newest), F.asc(key)).limit(limit)


def filter_radius(
    df: DataFrame, lon0: float, lat0: float, metres: float, key: str, limit: int | None = 100,
    lon: str = "lon", lat: str = "lat",
) -> DataFrame:
    """Rows within ``metres`` of a point, nearest first, with ``distance_m``.

    A latitude band and, away from the poles, a longitude band reach the scan
    before any distance is computed.
    """
    dlat = metres / EARTH_DEGREE_M
    df = df.where(F.col(lat).between(lat0 - dlat, lat0 + dlat))
    edge = min(89.9, abs(lat0) + dlat)
    # widest longitude span of a spherical cap
    span = math.sin(math.radians(dlat)) / math.cos(math.radians(abs(lat0))) if edge < 89.9 else 2.0
    if span < 1.0:
        dlon = math.degrees(math.asin(span))
        if -180 <= lon0 - dlon and lon0 + dlon <= 180:
            df = df.where(F.col(lon).between(lon0 - dlon, lon0 + dlon))
    near = df.withColumn("distance_m", haversine_m(F.col(lon), F.col(lat), F.lit(lon0), F.lit(lat0))).where(
        F.col("distance_m") <= metres
    )
    if limit is None:
        return near
    return near.orderBy("distance_m", key).limit(limit)


def paginate(df: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """One page of a totally ordered frame, each row with ``total`` and ``has_next``."""
    if page < 1 or not 1 <= page_size <= 1000:
        raise ValueError("page must be >= 1 and page_size within 1..1000")
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return rows.withColumn("total", total).withColumn("has_next", F.lit(page * page_size) < F.col("total"))
