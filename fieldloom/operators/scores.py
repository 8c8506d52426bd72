"""Composite indices, with their formulas stated here.

Bands follow public scales where one is named in the docstring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalar import clip, heat_index_c, weighted_score
from fieldloom.operators.aggregates import gini
from fieldloom.operators.scale import cumulative_counts, same_keys
from fieldloom.operators.timeseries import rolling


def percent_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, hot_rows: int | None = None) -> DataFrame:
    """(keys, value, name): share of a key's other rows with a smaller value, one row per distinct value."""
    cum = cumulative_counts(df, keys, value, hot_rows)
    totals = cum.groupBy(*keys).agg(F.sum("n").alias("_total"))
    share = F.coalesce(F.col("below") / F.nullif(F.col("_total") - 1, F.lit(0)), F.lit(0.0))
    return same_keys(cum, totals, keys).select(*keys, value, share.alias(name))


def percent_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, hot_rows: int | None = None) -> DataFrame:
    """Rows with their percent rank.

    Ranks are found over distinct values and joined back, so no key is sorted
    as a whole and a value with many copies is one row.
    """
    return same_keys(df, percent_ranks(df, keys, value, name, hot_rows), [*keys, value], "left")


def level_of(score: Column) -> Column:
    """low below 0.25, moderate below 0.5, high below 0.75, else extreme."""
    return F.when(score < 0.25, "low").when(score < 0.5, "moderate").when(score < 0.75, "high").when(score.isNotNull(), "extreme")


def ecosystem_score(richness: Column, habitat: Column, connectivity: Column, threat: Column) -> Column:
    """Equal-weight mean of richness, habitat, connectivity and 1 − threat, each within 0..1."""
    return weighted_score({
        "richness": (richness, 1.0), "habitat": (habitat, 1.0), "connectivity": (connectivity, 1.0), "threat": (1 - threat, 1.0),
    })[0]


def trend_label(slope: Column, dead_band: float) -> Column:
    """improving, declining, or stable within the dead band."""
    return F.when(slope > dead_band, "improving").when(slope < -dead_band, "declining").otherwise("stable")


def status_counts(df: DataFrame, species: str, status: str) -> DataFrame:
    """Species per conservation status and its share; a species is counted once."""
    once = df.select(species, status).distinct()
    total = once.agg(F.count(F.lit(1))).scalar()
    out = once.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("species_count"))
    return out.withColumn("share", F.col("species_count") / total).withColumn("threatened", F.col("status").isin("CR", "EN", "VU"))


def heat_vulnerability(temp_c: Column, humidity: Column, sensitivity: Column, capacity: Column) -> tuple[Column, Column]:
    """(heat index °C, score): mean of exposure (heat index from 27 to 54 °C as 0..1), sensitivity and 1 − capacity."""
    index = heat_index_c(temp_c, humidity)
    exposure = clip((index - 27.0) / 27.0, 0.0, 1.0)
    return index, (exposure + clip(sensitivity, 0.0, 1.0) + 1 - clip(capacity, 0.0, 1.0)) / 3


def vector_risk(df: DataFrame, keys: Sequence[str], factors: DataFrame, diseases: Sequence[str] | None = None) -> DataFrame:
    """Per key and disease: weighted mean of its factor values; ``df`` has (keys, factor, value), ``factors`` (disease, factor, weight)."""
    if diseases is not None:
        factors = factors.where(F.col("disease").isin(list(diseases)))
    means = df.groupBy(*keys, "factor").agg(F.avg(clip(F.col("value"), 0.0, 1.0)).alias("_v"))
    out = means.join(factors, "factor").groupBy(*keys, "disease").agg((F.sum(F.col("_v") * F.col("weight")) / F.sum("weight")).alias("risk"))
    return out.withColumn("level", level_of(F.col("risk")))


def overall_risk(risks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst disease per key."""
    return risks.groupBy(*keys).agg(F.max("risk").alias("overall"), F.max_by("disease", F.struct("risk", "disease")).alias("worst"))


def water_quality(df: DataFrame, keys: Sequence[str], thresholds: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted index 0..100 of parameter sub-indices, and its category.

    ``thresholds`` (parameter, low, high, sub_index) gives the sub-index of a
    value in [low, high); the join is on the parameter, the range refines it.
    """
    t = thresholds.withColumnRenamed("parameter", "_p")
    means = df.groupBy(*keys, "parameter").agg(F.avg("value").alias("_v"))
    scored = means.join(t, (F.col("parameter") == F.col("_p")) & (F.col("_v") >= F.col("low")) & (F.col("_v") < F.col("high"))).drop("_p")
    out = scored.join(weights, "parameter").groupBy(*keys).agg((F.sum(F.col("sub_index") * F.col("weight")) / F.sum("weight")).alias("wqi"))
    w = F.col("wqi")
    return out.withColumn(
        "category", F.when(w >= 90, "excellent").when(w >= 70, "good").when(w >= 50, "medium").when(w >= 25, "bad").otherwise("very bad")
    )


def drought_class(percentile: Column) -> Column:
    """Drought Monitor class of a soil-moisture percentile 0..100: D0 at 30 and below, D1 20, D2 10, D3 5, D4 2; else none."""
    return (
        F.when(percentile <= 2, "D4").when(percentile <= 5, "D3").when(percentile <= 10, "D2").when(percentile <= 20, "D1")
        .when(percentile <= 30, "D0").when(percentile.isNotNull(), "none")
    )


def drought(df: DataFrame, cell: str, moisture: str, hot_rows: int | None = None) -> DataFrame:
    """Rows with the percentile of their moisture in their cell's record, and the class."""
    ranked = percent_rank(df, [cell], moisture, "_pr", hot_rows)
    return ranked.withColumn("percentile", F.col("_pr") * 100).withColumn("drought", drought_class(F.col("percentile"))).drop("_pr")


def standardised_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, rows: int, hot_rows: int | None = None
) -> DataFrame:
    """z of the rolling sum within its key: a precipitation index without the gamma fit."""
    sums = rolling(df, keys, order, value, rows, ("sum",), hot_rows)
    total = f"{value}_sum"
    base = sums.groupBy(*keys).agg(F.avg(total).alias("_m"), F.stddev_samp(total).alias("_s"))
    return same_keys(sums, base, keys).withColumn("index", (F.col(total) - F.col("_m")) / F.nullif("_s", F.lit(0.0))).drop("_m", "_s")


def food_index(availability: Column, access: Column, utilization: Column, stability: Column) -> Column:
    """Equal-weight mean of the four pillars, each within 0..1."""
    return weighted_score({
        "availability": (availability, 1.0), "access": (access, 1.0), "utilization": (utilization, 1.0), "stability": (stability, 1.0),
    })[0]


def food_class(score: Column) -> Column:
    """secure from 0.8, mildly insecure from 0.6, moderately from 0.4, severely below."""
    return (
        F.when(score >= 0.8, "secure").when(score >= 0.6, "mildly insecure").when(score >= 0.4, "moderately insecure")
        .when(score.isNotNull(), "severely insecure")
    )


def water_stress(demand: Column, supply: Column) -> tuple[Column, Column]:
    """(ratio, severity) with the baseline water stress bands 0.1, 0.2, 0.4, 0.8."""
    ratio = demand / F.nullif(supply, F.lit(0.0))
    return ratio, (
        F.when(ratio < 0.1, "low").when(ratio < 0.2, "low-medium").when(ratio < 0.4, "medium-high").when(ratio < 0.8, "high")
        .when(ratio.isNotNull(), "extremely high")
    )


def env_justice(df: DataFrame, key: str, categories: dict[str, Sequence[str]], hot_rows: int | None = None) -> DataFrame:
    """Percentile (0..100) of every indicator, mean per category, overall mean, class by quarters."""
    out = df
    for names in categories.values():
        for n in names:
            # ranks come from the input, not from the frame joined so far
            out = same_keys(out, percent_ranks(df, [], n, f"_p_{n}", hot_rows), [n], "left")
    cols = []
    for cat, names in categories.items():
        total = None
        for n in names:
            term = F.col(f"_p_{n}") * 100
            total = term if total is None else total + term
        cols.append((total / len(names)).alias(cat))
    scored = out.select(key, *cols)
    overall = None
    for cat in categories:
        overall = F.col(cat) if overall is None else overall + F.col(cat)
    scored = scored.withColumn("overall", overall / len(categories))
    return scored.withColumn("class", level_of(F.col("overall") / 100))


def energy(df: DataFrame, keys: Sequence[str], use: str, renewable: str, people: str, access: str) -> DataFrame:
    """Access share, renewable share, use per head, and equity = 1 − Gini of the units' use per head."""
    base = df.groupBy(*keys).agg(
        F.avg(F.col(access).cast("double")).alias("access_share"),
        (F.sum(renewable) / F.nullif(F.sum(use), F.lit(0.0))).alias("renewable_share"),
        (F.sum(use) / F.nullif(F.sum(people), F.lit(0))).alias("use_per_head"),
    )
    heads = df.withColumn("_h", F.col(use) / F.nullif(F.col(people), F.lit(0)))
    equity = gini(heads, keys, "_h").select(*keys, (1 - F.col("gini")).alias("equity"))
    return same_keys(base, equity, keys)


def forecast_baseline(
    df: DataFrame, keys: Sequence[str], value: str, ts: str, horizon: int, step_seconds: int = 3600, season: str = "hour"
) -> DataFrame:
    """Per key: linear trend plus the mean of each season, ±1.96 residual std, for the ``horizon`` steps after the last row.

    Every stage is an aggregate: trend moments, then seasonal means of the
    detrended values, then the residual spread.
    """
    t0 = F.unix_seconds(ts) / float(step_seconds)
    part = {"hour": F.hour, "day": F.dayofweek, "month": F.month}[season]
    rows = df.select(*keys, t0.alias("_t"), part(ts).alias("_season"), F.col(ts).alias("_ts"), F.col(value).alias("_v")).where("_v IS NOT NULL")
    # time from the key's first row keeps the moments well conditioned
    start = rows.groupBy(*keys).agg(F.min("_t").alias("_t0"), F.max("_ts").alias("_last"))
    rows = same_keys(rows, start, keys).withColumn("_x", F.col("_t") - F.col("_t0"))
    line = rows.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("_v", "_x"), F.lit(0.0)).alias("_b"), F.coalesce(F.regr_intercept("_v", "_x"), F.avg("_v")).alias("_a")
    )
    detrended = same_keys(rows, line, keys).withColumn("_d", F.col("_v") - F.col("_a") - F.col("_b") * F.col("_x"))
    # Σd and Σd² per season give both the seasonal mean and the residual spread
    seasons = detrended.groupBy(*keys, "_season").agg(F.avg("_d").alias("_s"), F.var_pop("_d").alias("_var"), F.count("_d").alias("_n"))
    spread = seasons.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_var") * F.col("_n")) / F.sum("_n")).alias("_std"))
    ahead = same_keys(same_keys(start, line, keys), spread, keys).select(
        *keys, "_t0", "_a", "_b", "_std",
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda i: F.timestamp_seconds(F.unix_seconds("_last") + i * step_seconds))).alias("ts"),
    ).withColumn("_season", part("ts"))
    joined = same_keys(ahead, seasons.select(*keys, "_season", "_s"), [*keys, "_season"], "left")
    x = F.unix_seconds("ts") / float(step_seconds) - F.col("_t0")
    point = F.col("_a") + F.col("_b") * x + F.coalesce("_s", F.lit(0.0))
    return joined.select(
        *keys, "ts", point.alias("predicted"), (point - 1.96 * F.col("_std")).alias("lower"), (point + 1.96 * F.col("_std")).alias("upper")
    )
