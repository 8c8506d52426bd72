"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalar import aqi, aqi_category, severity_of_z
from fieldloom.functions.stats import t_two_sided_p
from fieldloom.operators.scale import quantiles, running_sums, same_keys, with_position
from fieldloom.operators.timeseries import bounds_z


def summary(df: DataFrame, keys: Sequence[str], value: str, hot_rows: int | None = None) -> DataFrame:
    """count, mean, std, min, max, q25, median, q75, skewness, kurtosis (both population forms, kurtosis as excess)."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"),
    )
    q = quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, hot_rows)
    return same_keys(base, q, keys)


def monthly_means(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(*keys, F.month(ts).alias("month")).agg(F.avg(value).alias("mean"))


def continuous(df: DataFrame, keys: Sequence[str], value: str, unit: str = "day", ts: str = "ts") -> DataFrame:
    """Per calendar bucket and key: avg, min, max, count."""
    return df.groupBy(F.date_trunc(unit, ts).alias("bucket"), *keys).agg(
        F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.count(F.lit(1)).alias("n"),
    )


def share_of_total(df: DataFrame, keys: Sequence[str], item: Sequence[str], amount: str) -> DataFrame:
    """Sum per (keys, item) with its percentage of the key's total.

    Both levels are aggregates; the window sees one row per item.
    """
    sums = df.groupBy(*keys, *item).agg(F.sum(amount).alias("amount"))
    total = sums.groupBy(*keys).agg(F.sum("amount").alias("total"))
    return same_keys(sums, total, keys).withColumn(
        "percentage", F.when(F.col("total") > 0, F.col("amount") / F.col("total") * 100).otherwise(0.0)
    )


# fixed values: statuses counted as endangered
ENDANGERED = ["CR", "EN", "VU"]


def species_richness(
    df: DataFrame, region: str, species: str, status: str, at_least: int = 1, approximate: bool = False
) -> DataFrame:
    """Distinct species per region, how many are endangered, and their ratio; richest first.

    Distinct (region, species) pairs first, so a region with most of the rows
    still spreads over its species. ``approximate`` uses sketches instead.
    """
    risky = F.col(status).isin(ENDANGERED)
    if approximate:
        out = df.groupBy(region).agg(
            F.approx_count_distinct(species).alias("species_count"),
            F.approx_count_distinct(F.when(risky, F.col(species))).alias("endangered_count"),
        )
    else:
        pairs = df.where(F.col(species).isNotNull()).groupBy(region, species).agg(F.max(risky.cast("int")).alias("_r"))
        out = pairs.groupBy(region).agg(
            F.count(F.lit(1)).alias("species_count"), F.sum(F.coalesce("_r", F.lit(0))).alias("endangered_count")
        )
    return out.where(F.col("species_count") >= at_least).withColumn(
        "vulnerability_ratio", F.col("endangered_count") / F.col("species_count")
    ).orderBy(F.desc("species_count"), region)


def shannon(df: DataFrame, keys: Sequence[str], species: str) -> DataFrame:
    """Shannon index -Σ p ln p and richness; with n = Σc it is ln n − Σ c ln c / n, one pass over the counts."""
    counts = df.groupBy(*keys, species).agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c")
    return counts.groupBy(*keys).agg(
        (F.log(n) - F.sum(F.col("_c") * F.log("_c")) / n).alias("shannon"), F.count(F.lit(1)).alias("richness"), n.alias("n")
    )


def species_summary(df: DataFrame, species: str, observed: str) -> DataFrame:
    return df.groupBy(species).agg(F.count(F.lit(1)).alias("observation_count"), F.max(observed).alias("last_observed"))


def air_station(df: DataFrame) -> DataFrame:
    """Per station: AQI = worst of the latest reading of each pollutant, the dominant one, readings, category.

    The list holds one entry per pollutant, whatever the number of readings.
    """
    latest = df.groupBy("station", "parameter").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    scored = latest.withColumn("aqi", aqi(F.col("parameter"), F.col("value")))
    out = scored.groupBy("station").agg(
        F.max("aqi").alias("aqi"),
        F.max_by("parameter", F.struct("aqi", "parameter")).alias("dominant"),
        F.sort_array(F.collect_list(F.struct("parameter", "value", "aqi"))).alias("readings"),
    )
    return out.withColumn("category", aqi_category(F.col("aqi")))


def correlations(df: DataFrame, columns: Sequence[str], at_least: float = 0.0) -> DataFrame:
    """All pairs a < b: Pearson r over the rows where both are present, n, and an approximate p.

    Every pair's moments come from one aggregate over the table.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [F.corr(a, b).alias(f"r{i}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)
    ]))
    long = wide.select(rows.alias("s")).select("s.*").where(F.abs("r") >= at_least)
    t = F.col("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return long.withColumn("p_value", F.when(F.col("n") > 2, F.coalesce(t_two_sided_p(t, F.col("n") - 2), F.lit(0.0))))


def pivot_series(df: DataFrame, index: Column, variables: Sequence[str], variable: str, value: str) -> DataFrame:
    """One column per listed variable: mean value at each index."""
    aggs = [F.avg(F.when(F.col(variable) == v, F.col(value))).alias(v) for v in variables]
    return df.groupBy(index.alias("at")).agg(*aggs)


def trend(df: DataFrame, keys: Sequence[str], value: str, year: Column, per: float = 10.0) -> DataFrame:
    """Linear trend of yearly means: slope per decade, r², p, direction, years."""
    yearly = df.groupBy(*keys, year.cast("double").alias("_year")).agg(F.avg(value).alias("_mean"))
    out = yearly.groupBy(*keys).agg(
        (F.regr_slope("_mean", "_year") * per).alias("per_decade"), F.regr_r2("_mean", "_year").alias("r2"),
        F.count(F.lit(1)).alias("years"),
    )
    n = F.col("years")
    t = F.sqrt(F.col("r2") * (n - 2) / F.nullif(1 - F.col("r2"), F.lit(0.0)))
    return out.withColumn("p_value", F.when(n > 2, t_two_sided_p(t, n - 2))).withColumn(
        "direction",
        F.when(F.col("per_decade") > 0, "increasing").when(F.col("per_decade") < 0, "decreasing").otherwise("stable"),
    )


def baseline_anomaly(
    recent: DataFrame, baseline: DataFrame, keys: Sequence[str], value: str, k: float = 2.0
) -> DataFrame:
    """Recent rows against the climatology of their key: z, expected range, severity."""
    bounds = bounds_z(baseline, keys, value, k)
    joined = same_keys(recent, bounds, keys)
    z = (F.col(value) - F.col("baseline_mean")) / F.nullif("baseline_std", F.lit(0.0))
    return joined.withColumn("z", z).withColumn("severity", severity_of_z(z)).where(F.abs("z") >= k)


def quality_report(
    df: DataFrame, columns: Sequence[str], unique_by: Sequence[str], numeric: Sequence[str], rules: dict[str, Column],
    ts: str,
) -> DataFrame:
    """One row: share missing, duplicate, outlying (beyond 3 std) and rule-breaking, last update, overall score."""
    bounds = df.agg(F.struct(*[
        x for c in numeric for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))
    ])).scalar()
    marked = df.withColumn("_b", bounds)
    outlier = reduce(
        lambda a, b: a + b,
        [F.coalesce((F.abs(F.col(c) - F.col(f"_b.m_{c}")) > 3 * F.col(f"_b.s_{c}")).cast("int"), F.lit(0)) for c in numeric],
    )
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    n = F.count(F.lit(1))
    wide = marked.agg(
        n.alias("rows"), (F.try_divide(F.sum(missing), n * len(columns)) * 100).alias("missing_pct"),
        (F.try_divide(F.sum(outlier), n * len(numeric)) * 100).alias("outlier_pct"),
        *[(F.try_divide(F.sum((~F.coalesce(rule, F.lit(False))).cast("int")), n) * 100).alias(f"broken_{name}_pct") for name, rule in rules.items()],
        F.max(ts).alias("last_update"),
    )
    distinct = df.groupBy(*unique_by).agg(F.count(F.lit(1)).alias("_c")).agg(
        (F.sum(F.col("_c") - 1) / F.sum("_c") * 100).alias("p")
    ).scalar()
    broken = reduce(lambda a, b: a + b, [F.col(f"broken_{name}_pct") for name in rules]) / len(rules)
    return wide.withColumn("duplicate_pct", distinct).withColumn(
        "overall",
        (4 * 100 - F.col("missing_pct") - F.col("duplicate_pct") - F.col("outlier_pct") - broken) / 4,
    )


def change_pct(predicted: Column, historical: Column) -> Column:
    return (predicted - historical) / F.nullif(historical, F.lit(0.0)) * 100


def allocate(df: DataFrame, key: str, weight: str, budget_cents: int) -> DataFrame:
    """Split a budget in whole cents by weight; the cents left by rounding down go to the largest remainders."""
    total = df.agg(F.sum(weight)).scalar()
    exact = F.col(weight) / F.col("_total") * budget_cents
    shares = df.withColumn("_total", total).withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.col("_floor"))
    left = shares.agg((F.lit(budget_cents) - F.sum("_floor")).cast("long")).scalar()
    ranked = with_position(shares, [], [F.desc("_rest"), F.asc(key)], "_rank").withColumn("_left", left)
    cents = F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")
    return ranked.select(key, cents.alias("cents"), (F.col(weight) / F.col("_total") * 100).alias("allocation_pct"))


def gini(df: DataFrame, keys: Sequence[str], value: str, hot_rows: int | None = None) -> DataFrame:
    """Gini index by ranks; 0 when the values sum to 0.

    Equal values are counted first: a run of ``n`` equal values after ``below``
    smaller ones has rank sum n·below + n(n+1)/2, so no row order is needed.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sums(counts, keys, [F.col(value)], {"_below": F.col("_n")}, include_current=False, hot_rows=hot_rows)
    n, x = F.col("_n"), F.col(value)
    sums = cum.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(n * x).alias("_sx"),
        F.sum(x * (n * F.col("_below") + n * (n + 1) / 2)).alias("_srx"),
    )
    size = F.col("n")
    formula = 2 * F.col("_srx") / (size * F.nullif("_sx", F.lit(0.0))) - (size + 1) / size
    return sums.select(*keys, F.coalesce(formula, F.lit(0.0)).alias("gini"), size)


def fairness(df: DataFrame, keys: Sequence[str], sector: str, value: str) -> DataFrame:
    """Over the sector means of each key: Gini, min/max ratio, coefficient of variation (population std)."""
    means = df.groupBy(*keys, sector).agg(F.avg(value).alias("_mean"))
    base = means.groupBy(*keys).agg(
        (F.min("_mean") / F.nullif(F.max("_mean"), F.lit(0.0))).alias("min_max_ratio"),
        (F.stddev_pop("_mean") / F.nullif(F.avg("_mean"), F.lit(0.0))).alias("cv"),
    )
    return same_keys(base, gini(means, keys, "_mean").drop("n"), keys)


def policy_summary(
    df: DataFrame, policy: str, episode: str, reward: str, threshold: float = 0.0
) -> DataFrame:
    """Per policy over its episodes: mean, population std, min, max, mean length, success rate."""
    totals = df.groupBy(policy, episode).agg(F.sum(reward).alias("_r"), F.count(F.lit(1)).alias("_len"))
    return totals.groupBy(policy).agg(
        F.count(F.lit(1)).alias("episodes"), F.avg("_r").alias("mean_reward"), F.stddev_pop("_r").alias("std_reward"),
        F.min("_r").alias("min_reward"), F.max("_r").alias("max_reward"), F.avg("_len").alias("mean_length"),
        F.avg((F.col("_r") >= threshold).cast("double")).alias("success_rate"),
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 50) -> DataFrame:
    """(bin, n) over equal-width bins between a key's least and greatest value, the last one closed; empty bins 0."""
    spans = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    placed = same_keys(df.where(F.col(value).isNotNull()), spans, keys)
    raw = F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins)
    counts = placed.groupBy(*keys, F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spine = spans.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return same_keys(spine, counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def last_non_null(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """Per key and column the last (or first) value that is not null, by ``order``."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(
        *[pick(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns]
    )


def rollup_levels(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Totals of every prefix of ``levels``, with the grouping id."""
    return df.rollup(*levels).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")
    )


def cube_levels(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    return df.cube(*levels).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def dashboard(rows: DataFrame) -> DataFrame:
    """Rows (domain, metric, alerts, risk_rank) plus the overall row ``all``: total alerts and worst risk."""
    overall = rows.agg(
        F.lit("all").alias("domain"), F.lit(None).cast("double").alias("metric"), F.sum("alerts").alias("alerts"),
        F.max("risk_rank").alias("risk_rank"),
    )
    return rows.select("domain", "metric", "alerts", "risk_rank").unionByName(overall)
