"""Scalar formulas as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: upper concentration, index at the lower end, index span (per pollutant)
AQI_SEGMENTS: dict[str, list[tuple[float | None, float, float, float, float]]] = {
    # (segment end, segment start, segment width, index at start, index span); None = open end
    "pm25": [
        (12.0, 0.0, 12.0, 0, 50), (35.4, 12.0, 23.4, 50, 50), (55.4, 35.4, 20.0, 100, 50),
        (150.4, 55.4, 95.0, 150, 50), (250.4, 150.4, 100.0, 200, 100), (None, 250.4, 150.0, 300, 200),
    ],
    "pm10": [(54.0, 0.0, 54.0, 0, 50), (154.0, 54.0, 100.0, 50, 50), (None, 154.0, 200.0, 100, 100)],
    "o3": [(54.0, 0.0, 54.0, 0, 50), (70.0, 54.0, 16.0, 50, 50), (None, 70.0, 95.0, 100, 100)],
}
AQI_BANDS = [
    (50, "Good"), (100, "Moderate"), (150, "Unhealthy for Sensitive Groups"), (200, "Unhealthy"),
    (300, "Very Unhealthy"),
]
SEVERITIES = ["info", "low", "medium", "high", "critical"]
DROUGHT_CLASSES = ["D0", "D1", "D2", "D3", "D4"]


def banded(value: Column, bands: Sequence[tuple[float, str]], rest: str) -> Column:
    """Label of the first band whose upper end is not below ``value``."""
    out = F.lit(rest)
    for upper, label in reversed(bands):
        out = F.when(value <= upper, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def aqi(parameter: Column, value: Column) -> Column:
    """Air quality index 0..500 of one concentration; truncated, not rounded."""

    def piecewise(segments):
        out = None
        for end, start, width, low, span in reversed(segments):
            line = low + (value - start) / width * span
            out = line if out is None else F.when(value <= end, line).otherwise(out)
        return out

    raw = F.least(value * 2, F.lit(500.0))
    for name, segments in AQI_SEGMENTS.items():
        raw = F.when(parameter == name, piecewise(segments)).otherwise(raw)
    return F.greatest(F.lit(0), F.least(F.lit(500), raw.cast("int")))


def aqi_category(index: Column) -> Column:
    return banded(index, AQI_BANDS, "Hazardous")


def rank_in(value: Column, ordered: Sequence[str]) -> Column:
    """1-based rank of an ordered label; 0 when unknown."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in ordered]), value), F.lit(0))


def severity_rank(value: Column) -> Column:
    return rank_in(value, SEVERITIES)


def drought_rank(value: Column) -> Column:
    return rank_in(value, DROUGHT_CLASSES)


def severity_of_z(z: Column) -> Column:
    """abs(z): 4 critical, 3 high, 2 medium, else low."""
    a = F.abs(z)
    return F.when(a >= 4, "critical").when(a >= 3, "high").when(a >= 2, "medium").when(a.isNotNull(), "low")


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0, within -1..1 (vegetation index for near-infrared and red)."""
    total = a + b
    return F.when(total == 0, 0.0).otherwise(clip((a - b) / F.nullif(total, F.lit(0.0)), -1.0, 1.0))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def rescale(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low) within 0..1; 0.5 for an empty range."""
    return F.when(high == low, F.lit(0.5)).otherwise(clip((x - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0))


def outside_distance(x: Column, low: float, high: float) -> Column:
    """How far ``x`` lies outside [low, high]."""
    return F.greatest(F.lit(low) - x, F.lit(0.0)) + F.greatest(x - F.lit(high), F.lit(0.0))


def threshold_penalty(x: Column, threshold: float, weight: float, power: float, upper: bool = True) -> Column:
    """weight * (excess over, or shortfall under, the threshold) ** power."""
    over = x - F.lit(threshold) if upper else F.lit(threshold) - x
    return F.lit(float(weight)) * F.pow(F.greatest(over, F.lit(0.0)), F.lit(float(power)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row (a lambda variable is bound, not repeated)."""
    return F.transform(F.array(value), body).getItem(0)


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""

    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda total: F.transform(e, lambda x: x / total))

    def shifted(v: Column) -> Column:
        return let(F.array_max(v), lambda m: let(F.transform(v, lambda x: F.exp(x - m)), shares))

    return let(values, shifted)


def weighted_score(parts: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """(score, breakdown map): weighted mean of parts clipped to 0..1; a missing part counts 0."""
    total = sum(w for _, w in parts.values())
    terms = {n: F.coalesce(clip(c, 0.0, 1.0), F.lit(0.0)) * F.lit(w / total) for n, (c, w) in parts.items()}
    score = None
    for term in terms.values():
        score = term if score is None else score + term
    return score, F.map_from_arrays(F.array(*[F.lit(n) for n in terms]), F.array(*terms.values()))


def unit_convert(variable: Column, unit: Column, value: Column) -> tuple[Column, Column]:
    """(value, unit): kelvin temperatures to °C, precipitation in m to mm, pressure in Pa to hPa."""
    kelvin = (unit == "K") & variable.contains("temperature")
    rain = variable == "total_precipitation"
    pascal = (unit == "Pa") & variable.contains("pressure")
    return (
        F.when(kelvin, value - 273.15).when(rain, value * 1000.0).when(pascal, value / 100.0).otherwise(value),
        F.when(kelvin, "°C").when(rain, "mm").when(pascal, "hPa").otherwise(unit),
    )


def season_fraction(ts: Column) -> Column:
    """Position in the year, 0..1."""
    return (F.dayofyear(ts) - 1) / F.lit(365.0)


def partial_date(text: Column) -> Column:
    """Timestamp of a date given as YYYY, YYYY-MM, an ISO date-time, or text starting YYYY-MM-DD; else null."""
    iso = F.regexp_replace(text, "Z$", "+00:00")
    return (
        F.when(F.length(text) == 4, F.try_to_timestamp(text, F.lit("yyyy")))
        .when(F.length(text) == 7, F.try_to_timestamp(text, F.lit("yyyy-MM")))
        .when(text.contains("T"), iso.try_cast("timestamp"))
        .otherwise(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))
    )


def heat_index_c(temp_c: Column, humidity: Column) -> Column:
    """Heat index in °C by the Rothfusz regression (US weather service), simple form below 80 °F."""
    t, r = temp_c * 9 / 5 + 32, humidity
    simple = 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + r * 0.094)
    # fixed values: Rothfusz coefficients
    full = (
        -42.379 + 2.04901523 * t + 10.14333127 * r - 0.22475541 * t * r - 0.00683783 * t * t
        - 0.05481717 * r * r + 0.00122874 * t * t * r + 0.00085282 * t * r * r - 0.00000199 * t * t * r * r
    )
    return (F.when((simple + t) / 2 < 80, simple).otherwise(full) - 32) * 5 / 9
