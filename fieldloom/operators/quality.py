"""Gates and clean-up of incoming rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.scalar import clip
from fieldloom.schemas import Check

# fixed values: accepted names of coordinate columns, preferred first
LAT_NAMES = ["latitude", "lat", "decimallatitude", "y", "lat_dd"]
LON_NAMES = ["longitude", "lon", "lng", "decimallongitude", "x", "lon_dd"]

# fixed values: statements refused in text meant for a graph query
UNSAFE = [r"\bDROP\b", r"\bDELETE\b", r"\bDETACH\b", r"\bCALL\b.*\bdbms\b", r"\bLOAD\s+CSV\b"]


def with_reasons(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Add ``reasons``: names of the checks a row fails, in declared order."""
    failed = F.array(*[F.when(~F.coalesce(c.condition, F.lit(False)), F.lit(c.name)) for c in checks])
    return df.withColumn("reasons", F.filter(failed, lambda r: r.isNotNull()))


def quality_gate(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``reasons``); both are narrow, single-pass plans."""
    marked = with_reasons(df, checks)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def validate_schema(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str]]:
    """(column, problem) for missing columns and types that do not fit.

    A type fits when the expected name is contained in the actual one, or both
    are numeric.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    numeric = {"byte", "short", "int", "integer", "bigint", "long", "float", "double", "decimal", "number"}
    problems = []
    for name, kind in expected.items():
        if name not in actual:
            problems.append((name, "missing"))
            continue
        have = actual[name].simpleString()
        wanted_number = any(kind.lower().startswith(n) for n in numeric)
        if kind.lower() not in have and not (wanted_number and isinstance(actual[name], T.NumericType)):
            problems.append((name, f"expected {kind}, found {have}"))
    return problems


def guarded(
    df: DataFrame, process: Callable[[DataFrame], DataFrame], required: dict[str, str],
    promised: dict[str, str] | None = None, name: str = "guarded",
) -> tuple[DataFrame, Observation, Observation]:
    """Check the input columns, process, check the output columns.

    Row counts before and after are observed while the result is written, so
    the emptiness test (``assert_not_empty``) costs no extra job.
    """
    problems = validate_schema(df, required)
    if problems:
        raise ValueError(f"input does not fit: {problems}")
    before, after = Observation(f"{name}_in"), Observation(f"{name}_out")
    out = process(df.observe(before, F.count(F.lit(1)).alias("rows")))
    problems = validate_schema(out, promised or {})
    if problems:
        raise ValueError(f"output does not fit: {problems}")
    return out.observe(after, F.count(F.lit(1)).alias("rows")), before, after


def assert_not_empty(*observations: Observation) -> None:
    """Raise when an observed stage saw no rows; call after the action."""
    for o in observations:
        if not o.get.get("rows"):
            raise ValueError("a guarded stage saw no rows")


def normalize_coords(df: DataFrame) -> DataFrame:
    """Columns ``latitude``/``longitude`` from any known alias: numeric, unswapped, inside their ranges.

    When more than half of the non-null latitudes lie beyond ±90 the two columns
    are taken to be swapped. That share is one aggregate, read as a scalar.
    """
    by_lower = {c.lower(): c for c in df.columns}
    lat = next((by_lower[n] for n in LAT_NAMES if n in by_lower), None)
    lon = next((by_lower[n] for n in LON_NAMES if n in by_lower), None)
    if lat is None or lon is None:
        raise ValueError("no coordinate columns")
    rest = [c for c in df.columns if c not in (lat, lon)]

    def number(name: str) -> Column:
        value = F.expr(f"try_cast(`{name}` as double)")
        return F.when(~F.isnan(value), value)

    cast = df.select(*rest, number(lat).alias("_lat"), number(lon).alias("_lon"))
    swapped = cast.agg(
        F.coalesce(F.sum((F.abs("_lat") > 90).cast("int")) * 2 > F.count("_lat"), F.lit(False))
    ).scalar()
    flagged = cast.withColumn("_swap", swapped)
    return flagged.select(
        *rest,
        clip(F.when(F.col("_swap"), F.col("_lon")).otherwise(F.col("_lat")), -90.0, 90.0).alias("latitude"),
        clip(F.when(F.col("_swap"), F.col("_lat")).otherwise(F.col("_lon")), -180.0, 180.0).alias("longitude"),
    )


def flatten_props(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Flat property columns: struct fields become ``parent_child`` one level deep,
    timestamps ISO text, scalar arrays stay, deeper values become JSON."""
    scalar = (T.StringType, T.NumericType, T.BooleanType)

    def value(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.TimestampType, T.DateType)):
            return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        if isinstance(kind, scalar):
            return col
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, scalar):
            return col
        return F.to_json(col)

    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.StructType):
            for child in f.dataType.fields:
                out.append(value(F.col(f.name)[child.name], child.dataType).alias(f"{f.name}_{child.name}"))
        else:
            out.append(value(F.col(f.name), f.dataType).alias(f.name))
    return df.select(*out)


def props_map(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``props``: the other columns as a map without its null values."""
    flat = flatten_props(df)
    others = [c for c in flat.columns if c not in keep]
    full = F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))])
    return flat.select(*keep, F.map_filter(full, lambda k, v: v.isNotNull()).alias("props"))


def sanitize_text(text: Column, limit: int = 1000) -> Column:
    """Cut to ``limit`` characters, drop NUL, strip white space - in that order."""
    cut = F.replace(F.substring(text, 1, limit), F.lit("\x00"), F.lit(""))
    return F.regexp_replace(cut, r"^\s+|\s+$", "")


def unsafe_text(text: Column) -> Column:
    """True when the text holds a refused statement."""
    return text.rlike("(?i)" + "|".join(UNSAFE))
