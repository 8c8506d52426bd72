"""Joins on keys, on time and on nearness of a score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.scale import carry_forward


def join_lookup(df: DataFrame, lookup: DataFrame, on: Column | str | Sequence[str], keep_unmatched: bool = False) -> DataFrame:
    """Equi join to a lookup; unmatched rows dropped unless kept. The join strategy follows the lookup's size."""
    return df.join(lookup, on, "left" if keep_unmatched else "inner")


def join_optional(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Every left row, once per match or once with nulls, and ``matches``, its number of matches.

    The count comes from an aggregate of the right side: no list of a group is built.
    """
    counts = right.groupBy(F.col(right_key).alias("_k")).agg(F.count(F.lit(1)).alias("matches"))
    out = left.join(counts, F.col(left_key) == F.col("_k"), "left").drop("_k")
    return out.join(right, F.col(left_key) == F.col(right_key), "left").withColumn(
        "matches", F.coalesce("matches", F.lit(0))
    )


def semi_exists(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Left rows that have a link."""
    return left.join(right, on, "left_semi")


def anti_missing(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Left rows that have no link."""
    return left.join(right, on, "left_anti")


def join_feature_outer(sets: dict[str, DataFrame | None], key: str) -> DataFrame:
    """Outer join of feature sets on an entity; a column already present gets the suffix ``_{set}``.

    Several rows of one entity in both sets give all combinations, as a join does; a missing set is skipped.
    """
    present = {name: df for name, df in sets.items() if df is not None}

    def step(acc: DataFrame | None, item: tuple[str, DataFrame]) -> DataFrame:
        name, df = item
        if acc is None:
            return df
        for c in df.columns:
            if c != key and c in acc.columns:
                df = df.withColumnRenamed(c, f"{c}_{name}")
        return acc.join(df, key, "full_outer")

    return reduce(step, present.items(), None)


def join_asof(
    labels: DataFrame, features: DataFrame, keys: Sequence[str], columns: Sequence[str],
    label_time: str = "at", feature_time: str = "ts", feature_seq: str | None = None, hot_rows: int | None = None,
) -> DataFrame:
    """Each label row with, per column, the entity's last non-null value at or before its time.

    Both sides are stacked and one ordered pass carries the values forward, so
    the cost is a sort, not a product of the two histories.
    """
    seq = F.col(feature_seq) if feature_seq else F.lit(0)
    f = features.select(*keys, F.col(feature_time).alias("_t"), F.lit(0).alias("_side"), seq.cast("long").alias("_seq"), *[F.col(c).alias(f"_f_{c}") for c in columns])
    own = [c for c in labels.columns if c not in keys]
    row = labels.select(*keys, F.col(label_time).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_seq"), F.struct(*own).alias("_row"))
    stacked = f.unionByName(row, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_side"), F.col("_seq")]
    carried = carry_forward(stacked, keys, order, {c: F.col(f"_f_{c}") for c in columns}, hot_rows=hot_rows)
    return carried.where("_side = 1").select(*keys, "_row.*", *columns)


def latest_before(features: DataFrame, keys: Sequence[str], columns: Sequence[str], at: Column, order: Sequence[str]) -> DataFrame:
    """Per entity the last non-null value of each column at or before one instant (filter, then an aggregate)."""
    from fieldloom.operators.aggregates import last_non_null

    return last_non_null(features.where(F.col(order[0]) <= at), keys, columns, order)


def join_nearest(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, score: str, hot_rows: int | None = None
) -> DataFrame:
    """(left_id, right_id, distance): each left row's nearest right row by ``score``; ties go to the lower id.

    Equal scores are one row with their lowest right id. Over these distinct
    scores the nearest right score below and above is carried in order.
    """
    a = left.select(F.col(score).alias("_s")).distinct().withColumn("_b", F.lit(None).cast(right.schema[right_id].dataType))
    b = right.groupBy(F.col(score).alias("_s")).agg(F.min(right_id).alias("_b"))
    scores = a.unionByName(b).where(F.col("_s").isNotNull()).groupBy("_s").agg(F.min("_b").alias("_b"))
    hit = F.when(F.col("_b").isNotNull(), F.struct("_s", "_b"))
    both = carry_forward(scores, [], [F.col("_s")], {"_low": hit}, hot_rows=hot_rows)
    both = carry_forward(both, [], [F.col("_s").desc()], {"_high": hit}, hot_rows=hot_rows)

    def candidate(side: str) -> Column:
        return F.when(
            F.col(side).isNotNull(),
            F.struct(F.abs(F.col(f"{side}._s") - F.col("_s")).alias("distance"), F.col(f"{side}._b").alias("id")),
        )

    best = both.withColumn("_best", F.array_min(F.filter(F.array(candidate("_low"), candidate("_high")), lambda c: c.isNotNull())))
    return left.join(best, F.col(score) == F.col("_s")).select(
        F.col(left_id), F.col("_best.id").alias(right_id), F.col("_best.distance").alias("distance")
    )
