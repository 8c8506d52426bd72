"""Robust aggregation of long parameter rows (client, key, idx, value, num_samples), and private sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.scale import cumulative_counts, quantiles, same_keys

# fixed values: orders of the Renyi accountant
RDP_ORDERS = [1 + x / 10.0 for x in range(1, 100)] + [float(x) for x in range(12, 64)]


def weighted_mean(df: DataFrame, coordinate: Sequence[str], value: str = "value", weight: str = "num_samples") -> DataFrame:
    """Sample-weighted mean per coordinate; equal weights when all are 0."""
    w = F.sum(F.col(weight))
    return df.groupBy(*coordinate).agg(
        F.when(w > 0, F.sum(F.col(weight) * F.col(value)) / F.nullif(w, F.lit(0))).otherwise(F.avg(value)).alias("value")
    )


def median(df: DataFrame, coordinate: Sequence[str], value: str = "value", hot_rows: int | None = None) -> DataFrame:
    """Lower median per coordinate."""
    return quantiles(df, coordinate, value, {"value": 0.5}, hot_rows, discrete=True)


def trimmed_mean(df: DataFrame, coordinate: Sequence[str], fraction: float, value: str = "value", hot_rows: int | None = None) -> DataFrame:
    """Mean without the ``int(n·fraction)`` smallest and largest values.

    Works on counts of equal values: of a run of ``n`` equal values at ranks
    below+1..below+n, the part between the two cuts is kept.
    """
    if not 0 <= fraction < 0.5:
        raise ValueError("fraction must be within [0, 0.5)")
    cum = cumulative_counts(df, coordinate, value, hot_rows)
    totals = cum.groupBy(*coordinate).agg(F.sum("n").alias("_n"))
    ranked = same_keys(cum, totals, coordinate)
    k = F.floor(F.col("_n") * fraction)
    kept = F.greatest(F.least(F.col("below") + F.col("n"), F.col("_n") - k) - F.greatest(F.col("below"), k), F.lit(0))
    return ranked.groupBy(*coordinate).agg(F.try_divide(F.sum(kept * F.col(value)), F.sum(kept)).alias("value"))


def round_metrics(df: DataFrame, round_col: str, client: str, loss: str) -> DataFrame:
    """Participants and mean client loss per round."""
    per_client = df.groupBy(round_col, client).agg(F.avg(loss).alias("_l"))
    return per_client.groupBy(round_col).agg(F.count(F.lit(1)).alias("participants"), F.avg("_l").alias("mean_loss"))


def clip_to_norm(df: DataFrame, contributor: str, value: str, norm: float) -> DataFrame:
    """Scale each contributor's vector down to an L2 norm of at most ``norm``."""
    norms = df.groupBy(contributor).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    scale = F.least(F.lit(1.0), F.lit(float(norm)) / F.nullif("_norm", F.lit(0.0)))
    return same_keys(df, norms, [contributor]).withColumn(value, F.col(value) * F.coalesce(scale, F.lit(1.0))).drop("_norm")


def noise_std(epsilon: float, delta: float, norm: float) -> float:
    """Standard deviation of the Gaussian mechanism."""
    return math.sqrt(2 * math.log(1.25 / delta)) / epsilon * norm


def private_sums(
    df: DataFrame, contributor: str, coordinate: str, value: str, norm: float, epsilon: float, delta: float, seed: int
) -> DataFrame:
    """Clipped sums per coordinate with Gaussian noise.

    The noise of a coordinate is a function of seed and coordinate (Box-Muller
    on two hashes), so a task that is run again adds the same noise and a second
    look at the result gives nothing away.
    """
    clipped = clip_to_norm(df, contributor, value, norm).groupBy(coordinate).agg(F.sum(value).alias("clipped_sum"))

    def uniform(salt: int) -> Column:
        h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(salt)), F.col(coordinate).cast("string")), 256), 1, 13), 16, 10)
        return (h.cast("double") + 1.0) / float(16**13 + 1)

    gauss = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * F.pi() * uniform(2))
    return clipped.withColumn("noisy_sum", F.col("clipped_sum") + F.lit(noise_std(epsilon, delta, norm)) * gauss)


def privacy_spent(rounds: DataFrame, keys: Sequence[str], sigma: str, rate: str | None, delta: float, budget: float) -> DataFrame:
    """Per key: total epsilon of its rounds, and whether it is within the budget.

    A round costs α/(2σ²) at order α with everyone taking part, and
    ln(1 + q²α(α−1)/(2σ²))/(α−1) when a share q < 1 is sampled. Costs add over
    rounds per order; the least bound over the orders counts. Equal rounds are
    counted before they meet the orders.
    """
    q = F.lit(1.0) if rate is None else F.col(rate).cast("double")
    kinds = rounds.select(*keys, F.col(sigma).cast("double").alias("_s"), q.alias("_q")).groupBy(*keys, "_s", "_q").agg(
        F.count(F.lit(1)).alias("_n")
    )
    a = F.col("_a")
    costs = kinds.withColumn("_a", F.explode(F.array(*[F.lit(x) for x in RDP_ORDERS])))
    variance = 2 * F.col("_s") * F.col("_s")
    one = F.when(F.col("_q") >= 1, a / variance).otherwise(F.log(1 + F.col("_q") * F.col("_q") * a * (a - 1) / variance) / (a - 1))
    cost = F.when(F.col("_s") == 0, F.lit(float("inf"))).otherwise(one)
    per_order = costs.groupBy(*keys, "_a").agg(F.sum(cost * F.col("_n")).alias("_rdp"), F.sum("_n").alias("_rounds"))
    return per_order.groupBy(*keys).agg(
        F.max("_rounds").alias("rounds"), F.min(F.col("_rdp") + F.lit(math.log(1 / delta)) / (a - 1)).alias("epsilon")
    ).withColumn("within_budget", F.col("epsilon") <= budget)
