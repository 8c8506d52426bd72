"""Reading tables by format name, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: leading bytes of the binary containers that are told apart
MAGIC = {"netcdf3": "43444601", "netcdf3_64": "43444602", "hdf5": "89484446", "grib": "47524942"}


def read_table(spark: SparkSession, fmt: str, path: str, schema: str, **options: str) -> DataFrame:
    """csv, json, parquet, orc, geojson (one FeatureCollection a file) or geojsonl (one feature a line).

    For GeoJSON ``schema`` describes the properties; the result has them as
    columns beside ``geometry_type`` and ``coordinates`` (JSON text).
    """
    fmt = fmt.lower()
    if fmt in ("geojson", "geojsonl"):
        feature = f"type STRING, geometry STRUCT<type STRING, coordinates STRING>, properties STRUCT<{schema}>"
        if fmt == "geojson":
            raw = spark.read.schema(f"features ARRAY<STRUCT<{feature}>>").option("multiLine", "true").json(path)
            raw = raw.select(F.explode("features").alias("f"))
        else:
            raw = spark.read.schema(feature).json(path).select(F.struct("type", "geometry", "properties").alias("f"))
        return raw.select(
            "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates")
        )
    if fmt not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"no reader for format {fmt}")
    if fmt == "csv":
        options = {"header": "true", "mode": "PERMISSIVE", **options}
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def container_kind(content: Column) -> Column:
    """Kind of a binary payload by its first bytes: netcdf3, hdf5, grib, or null."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(F.substring(head, 1, 6) == MAGIC["netcdf3"][:6], "netcdf3")
        .when(head == MAGIC["hdf5"], "hdf5").when(head == MAGIC["grib"], "grib")
    )


def scan_containers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, kind) of the binary files under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", container_kind(F.col("content")).alias("kind"))
