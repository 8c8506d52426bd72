"""Spherical distance, Web-Mercator tiles and polygons as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.scalar import let

EARTH_M = 6371008.8  # fixed value: mean earth radius
MERCATOR_M = 6378137.0  # fixed value: radius of EPSG:3857
MAX_LAT = 85.0511287798066  # fixed value: latitude where the Mercator square ends


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    phi = F.radians(F.greatest(F.least(lat, F.lit(MAX_LAT)), F.lit(-MAX_LAT)))
    y = F.floor((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / F.pi()) / 2.0 * n)
    return F.least(F.greatest(y, F.lit(0)), F.lit(n - 1)).cast("long")


def tile_id(zoom: int | Column, x: Column, y: Column) -> Column:
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    return F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string"))


def tile_of(lon: Column, lat: Column, zoom: int) -> Column:
    """Cell id ``z/x/y`` of a point."""
    return tile_id(zoom, tile_x(lon, zoom), tile_y(lat, zoom))


def tile_parent(tile: Column, levels: int) -> Column:
    """Ancestor ``levels`` above a ``z/x/y`` tile."""
    p = F.split(tile, "/")
    z, x, y = (p.getItem(i).cast("long") for i in range(3))
    return tile_id(z - levels, F.shiftright(x, levels), F.shiftright(y, levels))


def tile_bounds(tile: Column) -> tuple[Column, Column, Column, Column]:
    """(min_lon, min_lat, max_lon, max_lat) of a ``z/x/y`` tile."""
    p = F.split(tile, "/")
    z, x, y = (p.getItem(i).cast("double") for i in range(3))
    n = F.pow(F.lit(2.0), z)

    def lat(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * row / n))))

    return x / n * 360.0 - 180.0, lat(y + 1), (x + 1) / n * 360.0 - 180.0, lat(y)


def covering_tiles(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column, zoom: int) -> Column:
    """Array of ``x, y`` structs of the tiles a box touches."""
    xs = F.sequence(tile_x(min_lon, zoom), tile_x(max_lon, zoom))
    ys = F.sequence(tile_y(max_lat, zoom), tile_y(min_lat, zoom))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326."""
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - F.lit(math.pi / 2))


def ring_bbox(ring: Column) -> tuple[Column, Column, Column, Column]:
    """(min_lon, min_lat, max_lon, max_lat) of an array of ``lon, lat`` structs."""
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)


def _segments(ring: Column) -> Column:
    """Array of ``a, b`` point pairs along the ring, closing it."""

    def pairs(r: Column) -> Column:
        after = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
        return F.zip_with(r, after, lambda p, q: F.struct(p.alias("a"), q.alias("b")))

    return let(ring, pairs)


def ring_area_km2(ring: Column) -> Column:
    """Area of a ring on the sphere: half the sum of Δlon·(sin φ₁ + sin φ₂), times R²."""
    total = F.aggregate(
        _segments(ring),
        F.lit(0.0),
        lambda acc, s: acc
        + F.radians(s["b"]["lon"] - s["a"]["lon"]) * (F.sin(F.radians(s["a"]["lat"])) + F.sin(F.radians(s["b"]["lat"]))),
    )
    return F.abs(total) / 2 * (EARTH_M / 1000) ** 2


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting to the east: inside when it crosses the ring an odd number of times."""
    crossings = F.aggregate(
        _segments(ring),
        F.lit(0),
        lambda acc, s: acc
        + F.when(
            ((s["a"]["lat"] > lat) != (s["b"]["lat"] > lat))
            & (
                lon
                < (s["b"]["lon"] - s["a"]["lon"]) * (lat - s["a"]["lat"])
                / F.nullif(s["b"]["lat"] - s["a"]["lat"], F.lit(0.0)) + s["a"]["lon"]
            ),
            1,
        ).otherwise(0),
    )
    return crossings % 2 == 1
