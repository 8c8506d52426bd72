"""Top-k, unions and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows; ``order`` must end in a unique column. Planned as a top-k per partition and one merge."""
    return df.orderBy(*order).limit(k)


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key with ``rank``; Spark cuts each partition to k rows per key before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def union_domains(parts: dict[str, DataFrame], column: str = "domain") -> DataFrame:
    """One list of rows from frames whose columns may differ, each row tagged with its domain."""
    tagged = [df.withColumn(column, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_append(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows followed by new ones; a column missing on one side is null there."""
    return stored.unionByName(new, allowMissingColumns=True)


def roots_and_leaves(edges: DataFrame) -> DataFrame:
    """(node, role): causes that are never effects are roots, effects that are never causes are leaves."""
    causes, effects = edges.select(F.col("src").alias("node")), edges.select(F.col("dst").alias("node"))
    roots = causes.distinct().join(effects, "node", "left_anti").withColumn("role", F.lit("root"))
    leaves = effects.distinct().join(causes, "node", "left_anti").withColumn("role", F.lit("leaf"))
    return roots.unionByName(leaves)


def common_words(left: Column, right: Column) -> Column:
    """Distinct words two texts share."""

    def words(text: Column) -> Column:
        return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    return F.array_intersect(words(left), words(right))
