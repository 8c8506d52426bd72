"""Record schemas with their declared checks, used by the quality gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A named condition; a row fails it when the condition is not true."""

    name: str
    condition: Column


def in_range(column: str, low: float | None = None, high: float | None = None) -> Check:
    """Null passes: a missing optional value is no range error."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(column) >= low)
    if high is not None:
        ok = ok & (F.col(column) <= high)
    return Check(f"{column}_range", F.col(column).isNull() | (ok & ~F.isnan(F.col(column).cast("double"))))


def one_of(column: str, allowed: Sequence[str]) -> Check:
    return Check(f"{column}_value", F.col(column).isNull() | F.col(column).isin(list(allowed)))


def present(column: str) -> Check:
    return Check(f"{column}_missing", F.col(column).isNotNull())


# fixed values: enumerations of the records
DOMAINS = ["climate", "biodiversity", "health", "food_security", "resources"]
DROUGHT = ["D0", "D1", "D2", "D3", "D4"]
SEVERITY = ["info", "low", "medium", "high", "critical"]


@dataclass(frozen=True)
class Record:
    """A record type: its columns as DDL and the checks its values must pass."""

    ddl: str
    required: tuple[str, ...] = ()
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    values: dict[str, Sequence[str]] = field(default_factory=dict)

    def checks(self) -> list[Check]:
        return [
            *[present(c) for c in self.required],
            *[in_range(c, lo, hi) for c, (lo, hi) in self.ranges.items()],
            *[one_of(c, v) for c, v in self.values.items()],
        ]


BOX = "min_lon DOUBLE, min_lat DOUBLE, max_lon DOUBLE, max_lat DOUBLE"
POINT_RANGES = {"longitude": (-180.0, 180.0), "latitude": (-90.0, 90.0)}
UNIT = (0.0, 1.0)

RECORDS: dict[str, Record] = {
    "climate_observation": Record(
        "id STRING, variable STRING, value DOUBLE, unit STRING, longitude DOUBLE, latitude DOUBLE, elevation_m DOUBLE, "
        "cell STRING, ts TIMESTAMP, source STRING, quality_flag INT, uncertainty DOUBLE, metadata MAP<STRING,STRING>",
        ("variable", "value", "unit", "longitude", "latitude", "ts"),
        {**POINT_RANGES, "quality_flag": (0, 9)},
    ),
    "climate_anomaly": Record(
        f"id STRING, variable STRING, severity STRING, {BOX}, detected_at TIMESTAMP, baseline_mean DOUBLE, "
        "observed_value DOUBLE, deviation_sigma DOUBLE",
        ("variable", "severity", "detected_at"), {}, {"severity": SEVERITY},
    ),
    "climate_forecast": Record(
        f"id STRING, variable STRING, {BOX}, forecast_time TIMESTAMP, lead_hours INT, predicted_value DOUBLE, "
        "lower_bound DOUBLE, upper_bound DOUBLE, model_name STRING, confidence DOUBLE",
        ("variable", "forecast_time", "predicted_value"), {"confidence": UNIT},
    ),
    "species": Record(
        "id STRING, scientific_name STRING, common_name STRING, taxonomic_rank STRING, conservation_status STRING, "
        "taxonomy MAP<STRING,STRING>",
        ("scientific_name",),
    ),
    "species_observation": Record(
        "id STRING, species_id STRING, species_name STRING, longitude DOUBLE, latitude DOUBLE, elevation_m DOUBLE, "
        "cell STRING, observed_at TIMESTAMP, observer STRING, count INT, evidence_type STRING, confidence DOUBLE, "
        "source_dataset STRING",
        ("species_name", "observed_at"), {**POINT_RANGES, "count": (1, None), "confidence": UNIT},
    ),
    "ecosystem_health": Record(
        f"id STRING, {BOX}, cell STRING, ts TIMESTAMP, richness DOUBLE, habitat DOUBLE, connectivity DOUBLE, "
        "threat DOUBLE, overall DOUBLE, trend STRING",
        ("ts",), {c: UNIT for c in ("richness", "habitat", "connectivity", "threat", "overall")},
    ),
    "air_quality": Record(
        "id STRING, longitude DOUBLE, latitude DOUBLE, cell STRING, ts TIMESTAMP, aqi INT, pm25 DOUBLE, pm10 DOUBLE, "
        "ozone DOUBLE, no2 DOUBLE, so2 DOUBLE, co DOUBLE, source STRING",
        ("ts", "aqi"), {**POINT_RANGES, "aqi": (0, 500)},
    ),
    "disease_vector_risk": Record(
        f"id STRING, disease STRING, vector STRING, {BOX}, ts TIMESTAMP, risk_score DOUBLE, severity STRING, "
        "contributing_factors ARRAY<STRING>, population_at_risk INT",
        ("disease", "ts"), {"risk_score": UNIT}, {"severity": SEVERITY},
    ),
    "heat_vulnerability": Record(
        f"id STRING, {BOX}, ts TIMESTAMP, temperature_c DOUBLE, heat_index_c DOUBLE, vulnerability_score DOUBLE, "
        "at_risk_population INT",
        ("ts",), {"vulnerability_score": UNIT},
    ),
    "crop_yield": Record(
        f"id STRING, crop_type STRING, {BOX}, prediction_date DATE, harvest_date DATE, predicted DOUBLE, lower DOUBLE, "
        "upper DOUBLE, historical_avg DOUBLE, model_name STRING, confidence DOUBLE",
        ("crop_type",), {"confidence": UNIT},
    ),
    "drought_alert": Record(
        f"id STRING, severity STRING, {BOX}, onset_date DATE, expected_duration_days INT, affected_area_km2 DOUBLE, "
        "soil_moisture_percentile DOUBLE, precipitation_deficit_mm DOUBLE, affected_crops ARRAY<STRING>",
        ("severity",), {"soil_moisture_percentile": (0, 100)}, {"severity": DROUGHT},
    ),
    "food_security_index": Record(
        f"id STRING, {BOX}, cell STRING, ts TIMESTAMP, availability DOUBLE, access DOUBLE, utilization DOUBLE, "
        "stability DOUBLE, overall DOUBLE, population_affected BIGINT",
        ("ts",), {c: UNIT for c in ("availability", "access", "utilization", "stability", "overall")},
    ),
    "crop_landcover": Record(
        f"id STRING, year INT, {BOX}, cell STRING, crop_code INT, crop_name STRING, acreage DOUBLE, percentage DOUBLE",
        ("year", "crop_code"), {"acreage": (0, None), "percentage": (0, 100)},
    ),
    "water_stress": Record(
        f"id STRING, {BOX}, cell STRING, ts TIMESTAMP, demand_million_m3 DOUBLE, supply_million_m3 DOUBLE, "
        "stress_ratio DOUBLE, severity STRING",
        ("ts",), {"stress_ratio": (0, None)}, {"severity": SEVERITY},
    ),
    "environmental_justice": Record(
        f"id STRING, {BOX}, cell STRING, ts TIMESTAMP, pollution_burden DOUBLE, climate_vulnerability DOUBLE, "
        "health_disparity DOUBLE, resource_access DOUBLE, overall DOUBLE, demographic_indicators MAP<STRING,DOUBLE>",
        ("ts",),
        {c: UNIT for c in ("pollution_burden", "climate_vulnerability", "health_disparity", "resource_access", "overall")},
    ),
    "resource_allocation": Record(
        f"id STRING, resource_type STRING, {BOX}, ts TIMESTAMP, current DOUBLE, recommended DOUBLE, "
        "efficiency_gain_pct DOUBLE, equity_impact_score DOUBLE",
        ("resource_type",), {"equity_impact_score": UNIT},
    ),
    "ingestion_run": Record(
        "run_id STRING, source_name STRING, status STRING, started_at TIMESTAMP, finished_at TIMESTAMP, "
        "total_records BIGINT, total_duration_s DOUBLE, error_message STRING",
        ("source_name", "status"),
    ),
    "object": Record(
        "key STRING, data BINARY, metadata MAP<STRING,STRING>, created_at TIMESTAMP, updated_at TIMESTAMP", ("key", "data")
    ),
}
