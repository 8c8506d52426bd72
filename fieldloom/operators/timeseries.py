"""Regular series: resampling, anomalies, rolling statistics, gaps, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.scale import carry_forward, framed, quantiles, same_keys, with_position

AGGREGATES = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median,
    "std": F.stddev_samp, "var": F.var_samp, "count": F.count,
}


def bucket_start(ts: Column | str, step_seconds: int) -> Column:
    """Start of the fixed-length bucket a timestamp falls in."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts) / step_seconds) * step_seconds)


def resample(
    df: DataFrame, keys: Sequence[str], value: str, step_seconds: int, agg: str = "mean", ts: str = "ts",
    hot_rows: int | None = None,
) -> DataFrame:
    """(keys, ts, value) on regular buckets from a key's first to its last; empty buckets are null (0 for a sum).

    An unknown ``agg`` means mean.
    """
    placed = df.select(*keys, bucket_start(ts, step_seconds).alias("ts"), F.col(value).alias("value"))
    if agg == "median":
        present = placed.select(*keys, "ts").distinct()
        sums = same_keys(present, quantiles(placed, [*keys, "ts"], "value", {"value": 0.5}, hot_rows), [*keys, "ts"], "left")
    else:
        fn = AGGREGATES.get(agg, F.avg)
        sums = placed.groupBy(*keys, "ts").agg(fn("value").alias("value"))
    spans = sums.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    step = F.make_dt_interval(secs=F.lit(step_seconds))
    spine = spans.select(*keys, F.explode(F.sequence("_first", "_last", step)).alias("ts"))
    out = same_keys(spine, sums, [*keys, "ts"], "left")
    return out.withColumn("value", F.coalesce("value", F.lit(0.0))) if agg == "sum" else out


def _flag(df: DataFrame, bounds: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows strictly outside their key's bounds; the bounds frame has one row per key."""
    if keys:
        joined = same_keys(df, bounds, keys)
    else:
        names = bounds.columns
        joined = df.withColumn("_b", bounds.select(F.struct(*names)).scalar()).select("*", "_b.*").drop("_b")
    return joined.where((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))


def bounds_z(df: DataFrame, keys: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Per key: mean, sample std, and mean ± k·std; k = 0 falls back to 3."""
    k = float(k or 3.0)
    base = df.groupBy(*keys).agg(
        F.avg(value).alias("baseline_mean"), F.stddev_samp(value).alias("baseline_std"), F.count(value).alias("points")
    )
    return base.withColumn("lower", F.col("baseline_mean") - k * F.col("baseline_std")).withColumn(
        "upper", F.col("baseline_mean") + k * F.col("baseline_std")
    )


def bounds_iqr(df: DataFrame, keys: Sequence[str], value: str, hot_rows: int | None = None) -> DataFrame:
    """Per key: quartiles by linear interpolation, and the 1.5·IQR fences."""
    q = quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75}, hot_rows)
    spread = F.col("q3") - F.col("q1")
    return q.withColumn("lower", F.col("q1") - 1.5 * spread).withColumn("upper", F.col("q3") + 1.5 * spread)


def anomalies_z(df: DataFrame, keys: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Rows outside mean ± k·std of their key, with ``z`` and the baseline columns.

    The baseline is an aggregate joined back, not a window: no key is gathered
    in one task, and AQE broadcasts the baseline while it is small.
    """
    flagged = _flag(df, bounds_z(df, keys, value, k), keys, value)
    return flagged.withColumn("z", (F.col(value) - F.col("baseline_mean")) / F.nullif("baseline_std", F.lit(0.0)))


def anomalies_iqr(df: DataFrame, keys: Sequence[str], value: str, hot_rows: int | None = None) -> DataFrame:
    """Rows outside the 1.5·IQR fences of their key."""
    return _flag(df, bounds_iqr(df, keys, value, hot_rows), keys, value)


def anomaly_summary(df: DataFrame, keys: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Per key: points, anomalies, rate and bounds."""
    joined = same_keys(df, bounds_z(df, keys, value, k), keys)
    out = F.count_if((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))
    return joined.groupBy(*keys).agg(
        F.count(value).alias("total_points"), out.alias("anomaly_count"),
        F.try_divide(out, F.count(value)).alias("anomaly_rate"), F.max("upper").alias("upper"), F.max("lower").alias("lower"),
    )


def rolling(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, rows: int = 24,
    aggs: Sequence[str] = ("mean", "std"), hot_rows: int | None = None,
) -> DataFrame:
    """Statistics over the last ``rows`` rows (null rows count as rows, not as values).

    The median is taken from the sorted frame, which holds at most ``rows`` values.
    """

    def add(frame: DataFrame, w) -> DataFrame:
        w = w.rowsBetween(-(rows - 1), 0)
        out = []
        for name in aggs:
            if name == "median":
                vals = F.sort_array(F.collect_list(value).over(w))
                n = F.size(vals)
                mid = (F.get(vals, F.floor((n - 1) / 2).cast("int")) + F.get(vals, F.floor(n / 2).cast("int"))) / 2
                out.append(mid.alias(f"{value}_median"))
            else:
                out.append(AGGREGATES[name](value).over(w).alias(f"{value}_{name}"))
        return frame.select("*", *out)

    return framed(df, keys, order, add, before=rows - 1, hot_rows=hot_rows)


def change(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, periods: int = 1,
    hot_rows: int | None = None,
) -> DataFrame:
    """``pct_change`` (nulls padded forward first; null where the earlier value is 0) and ``diff`` (unpadded)."""
    padded = carry_forward(df, keys, order, {"_pad": F.col(value)}, hot_rows=hot_rows)

    def add(frame: DataFrame, w) -> DataFrame:
        earlier = F.lag("_pad", periods).over(w)
        return frame.withColumn("pct_change", F.col("_pad") / F.nullif(earlier, F.lit(0.0)) - 1).withColumn(
            "diff", F.col(value) - F.lag(value, periods).over(w)
        )

    return framed(padded, keys, order, add, before=periods, hot_rows=hot_rows).drop("_pad")


def interpolate_at(
    df: DataFrame, keys: Sequence[str], position: str, value: str, limit: Column | int | None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Fill null ``value`` linearly by row position, at most ``limit`` rows into each gap.

    Leading nulls stay; trailing nulls repeat the last value.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(position).alias("p")))
    both = carry_forward(df, keys, [F.col(position)], {"_prev": known}, hot_rows=hot_rows)
    both = carry_forward(both, keys, [F.col(position).desc()], {"_next": known}, hot_rows=hot_rows)
    offset = F.col(position) - F.col("_prev.p")
    slope = (F.col("_next.v") - F.col("_prev.v")) / (F.col("_next.p") - F.col("_prev.p"))
    guess = F.when(F.col("_next").isNull(), F.col("_prev.v")).otherwise(F.col("_prev.v") + slope * offset)
    allowed = F.lit(True) if limit is None else offset <= limit
    return both.withColumn(value, F.coalesce(F.col(value), F.when(allowed, guess))).drop("_prev", "_next")


def interpolate(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, limit: int | None = 5,
    hot_rows: int | None = None,
) -> DataFrame:
    """``interpolate_at`` with positions taken from ``order``."""
    placed = with_position(df, keys, order, "_at", hot_rows)
    return interpolate_at(placed, keys, "_at", value, limit, hot_rows).drop("_at")


def fill_gaps(
    df: DataFrame, keys: Sequence[str], value: str, max_gap_seconds: float, ts: str = "ts",
    hot_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(regular series, rows lost because they lie off its grid).

    The step of a key is the median distance of its rows; the grid runs from its
    first to its last row; gaps are filled linearly up to ``max_gap / step`` points.
    """
    rows = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(value).alias(value))

    def deltas(frame: DataFrame, w) -> DataFrame:
        return frame.withColumn("_delta", F.col("_us") - F.lag("_us").over(w))

    stepped = framed(rows, keys, [F.col("_us")], deltas, before=1, hot_rows=hot_rows)
    steps = quantiles(stepped.where(F.col("_delta").isNotNull()), keys, "_delta", {"_step": 0.5}, hot_rows)
    spans = rows.groupBy(*keys).agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    grids = same_keys(spans, steps, keys, "left").withColumn("_step", F.greatest(F.floor("_step"), F.lit(1)))
    # a key with one row has no step: its grid is that row
    grids = grids.withColumn("_step", F.coalesce("_step", F.lit(1)))
    spine = grids.select(
        *keys, "_first", "_step",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - F.col("_first")) / F.col("_step")))).alias("_i"),
    ).withColumn("_us", F.col("_first") + F.col("_i") * F.col("_step"))
    regular = same_keys(spine, rows, [*keys, "_us"], "left")
    limit = F.floor(F.lit(max_gap_seconds * 1_000_000.0) / F.col("_step"))
    filled = interpolate_at(regular, keys, "_i", value, limit, hot_rows)
    on_grid = (F.col("_us") - F.col("_first")) % F.col("_step") == 0
    lost = same_keys(rows, grids, keys).where(~on_grid)
    back = F.timestamp_micros("_us").alias(ts)
    return filled.select(*keys, back, value), lost.select(*keys, back, value)


def dedupe_keep(df: DataFrame, subset: Sequence[str], order: Sequence[str], keep: str | bool = "first") -> DataFrame:
    """One row per ``subset`` value: the first or last by ``order``, or (``keep=False``) only rows without a duplicate.

    A min/max-by aggregate, combined before the shuffle: a value with many
    copies sends one row per map task.
    """
    row, key = F.struct(*df.columns), F.struct(*order)
    pick = F.max_by(row, key) if keep == "last" else F.min_by(row, key)
    grouped = df.groupBy(*[F.col(c).alias(f"_k_{c}") for c in subset]).agg(
        pick.alias("_row"), F.count(F.lit(1)).alias("_n")
    )
    if keep is False:
        grouped = grouped.where("_n = 1")
    return grouped.select("_row.*")
