"""Records of public data sources to the common record types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalar import aqi, clip, partial_date, unit_convert
from fieldloom.operators.scale import same_keys

# fixed values: station data type -> (variable, unit)
STATION_TYPES = {
    "TAVG": ("temperature", "°C"), "TMAX": ("temperature", "°C"), "TMIN": ("temperature", "°C"),
    "PRCP": ("precipitation", "mm"), "AWND": ("wind_speed", "m/s"), "RHAV": ("humidity", "%"), "SLP": ("pressure", "hPa"),
}
TENTHS = ["TAVG", "TMAX", "TMIN", "PRCP"]

# fixed values: reanalysis variable -> (variable, unit)
GRID_VARIABLES = {
    "2m_temperature": ("temperature", "K"), "total_precipitation": ("precipitation", "m"),
    "10m_u_component_of_wind": ("wind_speed", "m/s"), "10m_v_component_of_wind": ("wind_speed", "m/s"),
    "surface_pressure": ("pressure", "Pa"), "2m_dewpoint_temperature": ("humidity", "K"),
    "soil_temperature_level_1": ("soil_moisture", "K"), "sea_surface_temperature": ("sea_surface_temperature", "K"),
}

# fixed values: crop code -> name
CROPS = {
    1: "Corn", 2: "Cotton", 3: "Rice", 4: "Sorghum", 5: "Soybeans", 6: "Sunflower", 21: "Barley", 23: "Spring Wheat",
    24: "Winter Wheat", 26: "Double Crop Winter Wheat/Soybeans", 27: "Rye", 28: "Oats", 36: "Alfalfa",
    37: "Other Hay/Non Alfalfa", 41: "Sugarbeets", 42: "Dry Beans", 43: "Potatoes", 44: "Other Crops",
    61: "Fallow/Idle Cropland", 111: "Open Water", 121: "Developed/Open Space", 131: "Barren", 141: "Deciduous Forest",
    142: "Evergreen Forest", 143: "Mixed Forest", 152: "Shrubland", 171: "Grassland/Pasture", 176: "Grass/Pasture",
    190: "Woody Wetlands", 195: "Herbaceous Wetlands",
}

POLLUTANTS = {"pm25": "pm25", "pm10": "pm10", "o3": "ozone", "no2": "no2", "so2": "so2", "co": "co"}


def _lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table as one map literal: no join."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), key)


def station_records(records: DataFrame, stations: DataFrame) -> DataFrame:
    """date, datatype, value, station, attributes ⨝ station coordinates -> climate observations.

    Unmapped data types and stations without coordinates are dropped.
    """
    kind = F.col("datatype")
    first = F.trim(F.split_part(F.trim("attributes"), F.lit(","), F.lit(1)))
    mapped = records.withColumn("variable", _lookup(kind, {k: v for k, (v, _) in STATION_TYPES.items()})).where(
        F.col("variable").isNotNull()
    )
    placed = mapped.join(stations.select(F.col("station").alias("_id"), "latitude", "longitude", "elevation"), F.col("station") == F.col("_id"))
    return placed.select(
        "variable", F.when(kind.isin(TENTHS), F.col("value") / 10).otherwise(F.col("value")).alias("value"),
        _lookup(kind, {k: u for k, (_, u) in STATION_TYPES.items()}).alias("unit"), "latitude", "longitude", "elevation",
        F.regexp_replace(F.regexp_replace("date", "T", " "), "Z+$", "").cast("timestamp").alias("ts"),
        F.concat(F.lit("station:"), F.col("station").cast("string")).alias("source"),
        F.when(first.rlike("^[0-9]+$"), first.cast("int")).otherwise(0).alias("quality_flag"),
        "datatype", "station",
    )


def occurrence_confidence(uncertainty: Column, issues: Column, media: Column) -> Column:
    """1, less 0.3 or 0.1 for coarse coordinates, less 0.05 an issue (0.3 at most), plus 0.05 with media; 0..1."""
    coarse = F.when(uncertainty > 10000, 0.3).when(uncertainty > 1000, 0.1).otherwise(0.0)
    n = F.greatest(F.coalesce(F.size(issues), F.lit(0)), F.lit(0))
    extra = F.when(F.coalesce(F.size(media), F.lit(0)) > 0, 0.05).otherwise(0.0)
    return clip(1.0 - coarse - F.least(F.lit(0.3), n * 0.05) + extra, 0.0, 1.0)


def occurrence_records(records: DataFrame) -> DataFrame:
    """Species occurrences -> species observations; rows without place, name or readable date are dropped."""

    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    out = records.select(
        "gbifID", F.coalesce(text("species"), text("scientificName")).alias("species_name"),
        F.col("decimalLatitude").alias("latitude"), F.col("decimalLongitude").alias("longitude"),
        F.when(text("eventDate").isNotNull(), partial_date(F.col("eventDate"))).alias("observed_at"),
        F.greatest(F.coalesce("individualCount", F.lit(1)), F.lit(1)).alias("count"),
        F.lower(F.coalesce("basisOfRecord", F.lit("HUMAN_OBSERVATION"))).alias("evidence_type"),
        occurrence_confidence(F.col("coordinateUncertaintyInMeters"), F.col("issues"), F.col("media")).alias("confidence"),
        F.concat(F.lit("occurrence:"), F.coalesce("datasetKey", F.lit(""))).alias("source_dataset"),
    )
    return out.where(
        "latitude IS NOT NULL AND longitude IS NOT NULL AND species_name IS NOT NULL AND observed_at IS NOT NULL"
    )


def air_records(records: DataFrame) -> DataFrame:
    """Air measurements -> one-pollutant readings with an AQI; rows without place, time or value are dropped."""
    point = F.coalesce("coordinates", "location.coordinates")
    out = records.select(
        "id", point["latitude"].alias("latitude"), point["longitude"].alias("longitude"),
        F.regexp_replace(F.col("date.utc"), "Z$", "+00:00").try_cast("timestamp").alias("ts"), "parameter",
        F.col("value").cast("double").alias("value"), aqi(F.coalesce("parameter", F.lit("")), F.col("value").cast("double")).alias("aqi"),
        *[F.when(F.col("parameter") == p, F.col("value").cast("double")).alias(c) for p, c in POLLUTANTS.items()],
        F.concat(F.lit("air:"), F.coalesce(F.col("location.id").cast("string"), F.lit("unknown"))).alias("source"),
    )
    return out.where("latitude IS NOT NULL AND longitude IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL")


def grid_records(grids: DataFrame, stride: int = 1) -> DataFrame:
    """Gridded fields (variable, time, lats, lons, values[][]) -> point observations.

    All cells by default; a ``stride`` keeps every so many indices of both axes, whatever the grid's size. NaN cells are
    skipped; values are converted and rounded to 4 digits. The row arrays are exploded before the cells are, so one grid
    row is the largest unit.
    """
    known = grids.withColumn("_name", _lookup(F.col("variable"), {k: v for k, (v, _) in GRID_VARIABLES.items()})).withColumn(
        "_unit", _lookup(F.col("variable"), {k: u for k, (_, u) in GRID_VARIABLES.items()})
    ).where(F.col("_name").isNotNull())
    rows = known.select("variable", "_name", "_unit", "time", "lats", "lons", F.posexplode("values").alias("_i", "_row")).where(F.col("_i") % stride == 0)
    cells = rows.select(
        "variable", "_name", "_unit", "time", F.get("lats", F.col("_i")).alias("latitude"), "lons",
        F.posexplode("_row").alias("_j", "raw"),
    ).where((F.col("_j") % stride == 0) & F.col("raw").isNotNull() & ~F.isnan("raw"))
    value, unit = unit_convert(F.col("variable"), F.col("_unit"), F.col("raw"))
    return cells.select(
        F.col("_name").alias("variable"), F.round(value, 4).alias("value"), unit.alias("unit"), "latitude",
        F.get("lons", F.col("_j")).alias("longitude"), F.col("time").alias("ts"), F.lit("reanalysis").alias("source"),
    )


def stac_items(items: DataFrame) -> DataFrame:
    """STAC items -> flat catalogue rows; assets become a map key -> href."""
    p = F.col("properties")
    return items.select(
        "id", F.coalesce("collection", F.lit("")).alias("collection"), p["datetime"].alias("datetime"), "bbox",
        p["eo:cloud_cover"].alias("cloud_cover"), F.coalesce(p["platform"], F.lit("")).alias("platform"), p["gsd"].alias("gsd"),
        F.transform_values("assets", lambda k, v: F.coalesce(v["href"], F.lit(""))).alias("assets"),
    )


def crop_acreage(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Crop acreage entries -> code, name, acreage, percentage of the page's total, largest first.

    The first parsable of several fields counts. The total covers every entry
    with a positive acreage, also those whose code cannot be read.
    """

    def first(names: list[str], kind: str) -> Column:
        cleaned = [F.regexp_replace(F.trim(n), ",", "") if kind == "double" else F.trim(n) for n in names if n in entries.columns]
        return F.coalesce(*[c.try_cast(kind) for c in cleaned])

    parsed = entries.withColumn("_code", first(["category", "cropCode", "code"], "int")).withColumn(
        "_acres", first(["acreage", "value", "area"], "double")
    ).where("_acres > 0")
    totals = parsed.groupBy(*keys).agg(F.sum("_acres").alias("_total"))
    fallback = F.coalesce("cropName", "category", F.concat(F.lit("Code_"), F.col("_code").cast("string")))
    return same_keys(parsed.where("_code IS NOT NULL"), totals, keys).select(
        *keys, F.col("_code").alias("crop_code"), F.coalesce(_lookup(F.col("_code"), CROPS), fallback).alias("crop_name"),
        F.round("_acres", 2).alias("acreage"), F.round(F.col("_acres") / F.col("_total") * 100, 2).alias("percentage"),
    )
