"""Ordered work inside keys, with keys of any size.

A window partitioned by a key puts the whole key into one task. That is fine for
keys of a few million rows and fatal for a key that holds a third of the table.
The helpers here take the plain window when no key is large (``hot_rows``) and
otherwise cut every key into ordered chunks:

* rows are range-partitioned on (keys, order), so that one key spans many chunks;
* each chunk is worked on alone;
* what a chunk needs from the chunks before it (a row count, a sum, a last value)
  is read from a summary with one row per chunk.

Both ways give the same rows; the tests run both.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import checkpointed

HOT_ROWS = 4_000_000
SMALL_BYTES = 32 * 1024 * 1024
MAX_CHUNKS = 20_000

Order = Sequence[str]


def estimated_bytes(df: DataFrame) -> int:
    """Size estimate of the optimised plan (file sizes for a plain scan).

    The estimate does not see rows made by an explode, so such a plan counts as large.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if "Generate " in plan.toString():
        return SMALL_BYTES + 1
    return int(plan.stats().sizeInBytes())


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key, by one map-side combined count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n").alias("_n")).first()["_n"] or 0


def chunk_count(df: DataFrame, keys: Sequence[str], hot_rows: int | None) -> int:
    """0 when every key fits one task, else the number of chunks to cut into."""
    if hot_rows is None and estimated_bytes(df) <= SMALL_BYTES:
        return 0
    limit = hot_rows or HOT_ROWS
    largest = largest_group(df, keys)
    if largest <= limit:
        return 0
    total = df.count()
    return max(2, min(MAX_CHUNKS, math.ceil(total / limit)))


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunks: int) -> DataFrame:
    """Rows with ``_chunk``: increasing along ``order`` inside every key.

    Range bounds come from a sample, so the assignment is fixed by a checkpoint
    before more than one branch of the plan reads it.
    """
    ranged = df.repartitionByRange(chunks, *[F.col(k) for k in keys], *order)
    return checkpointed(ranged.withColumn("_chunk", F.spark_partition_id()))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join where null equals null, keeping the left key columns.

    Without keys the right side is one row, attached as a scalar.
    """
    if not keys:
        return left.withColumn("_one", right.select(F.struct("*")).scalar()).select("*", "_one.*").drop("_one")
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        one, other = left[k], renamed[f"_r_{k}"]
        # plain equality lets the join reuse the partitioning of a preceding aggregate
        same = one.eqNullSafe(other) if left.schema[k].nullable and right.schema[k].nullable else one == other
        cond = same if cond is None else cond & same
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "_pos", hot_rows: int | None = None
) -> DataFrame:
    """1-based position of each row in its key; ``order`` must be total."""
    chunks = chunk_count(df, keys, hot_rows)
    if not chunks:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    parts = chunked(df, keys, order, chunks)
    sizes = parts.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        same_keys(parts.withColumn("_local", F.row_number().over(local)), offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "_chunk")
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    add: Callable[[DataFrame, Window], DataFrame],
    before: int = 0,
    after: int = 0,
    hot_rows: int | None = None,
) -> DataFrame:
    """Apply ``add(df, window)`` whose frames reach ``before``/``after`` rows.

    Large keys are cut into blocks of rows; every block also receives copies of
    the neighbouring rows its frames can reach, which are dropped at the end.
    """
    chunks = chunk_count(df, keys, hot_rows)
    if not chunks:
        return add(df, Window.partitionBy(*keys).orderBy(*order))
    block = max(hot_rows or HOT_ROWS, before + after + 1)
    placed = with_position(df, keys, order, hot_rows=hot_rows)
    index = F.col("_pos") - 1
    home = F.floor(index / block)
    first = F.floor(F.greatest(index - after, F.lit(0)) / block)
    last = F.floor((index + before) / block)
    copies = (
        placed.withColumn("_home", home)
        .withColumn("_block", F.explode(F.sequence(first, last)))
    )
    out = add(copies, Window.partitionBy(*keys, "_block").orderBy("_pos"))
    return out.where(F.col("_block") == F.col("_home")).drop("_pos", "_home", "_block")


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: dict[str, Column],
    include_current: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """Per output name, the last non-null value of its expression up to the row."""
    end = 0 if include_current else -1
    chunks = chunk_count(df, keys, hot_rows)
    if not chunks:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in columns.items()])
    with_values = df.select("*", *[c.alias(f"_v_{n}") for n, c in columns.items()])
    parts = chunked(with_values, keys, order, chunks)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = parts.withColumn("_local_row", F.row_number().over(local))
    # max_by skips rows whose ordering value is null: it picks the last non-null value
    ends = numbered.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_local_row"))).alias(f"_e_{n}")
            for n in columns
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, "_chunk", *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in columns]
    )
    frame = local.rowsBetween(Window.unboundedPreceding, end)
    joined = same_keys(
        numbered.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(frame).alias(f"_l_{n}") for n in columns]),
        carry,
        [*keys, "_chunk"],
    )
    return joined.select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in columns]
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: dict[str, Column],
    include_current: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """Per output name, the sum of its expression over the rows up to this one (0 before the first)."""
    end = 0 if include_current else -1
    chunks = chunk_count(df, keys, hot_rows)
    if not chunks:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in columns.items()])
    with_values = df.select("*", *[c.alias(f"_v_{n}") for n, c in columns.items()])
    parts = chunked(with_values, keys, order, chunks)
    totals = parts.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in columns])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in columns]
    )
    frame = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    joined = same_keys(
        parts.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0)).alias(f"_l_{n}") for n in columns]),
        offsets,
        [*keys, "_chunk"],
    )
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in columns])


def cumulative_counts(
    df: DataFrame, keys: Sequence[str], value: str, hot_rows: int | None = None
) -> DataFrame:
    """Distinct (keys, value) rows with ``n`` (copies) and ``below`` (rows of the key with a smaller value).

    Equal values are counted before any ordering, so a value that fills a third
    of the table is one row here.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(
        counts, keys, [F.col(value)], {"below": F.col("n")}, include_current=False, hot_rows=hot_rows
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    hot_rows: int | None = None,
    discrete: bool = False,
) -> DataFrame:
    """Exact quantiles per key: linear interpolation, or the lower value when ``discrete``.

    Small groups use the built-in exact aggregate (its buffer holds the distinct
    values of one group); large groups select the needed ranks from cumulative
    counts, which never holds a group in one place.
    """
    name = "percentile_disc" if discrete else "percentile_cont"
    if not chunk_count(df, keys, hot_rows):
        return df.groupBy(*keys).agg(
            *[F.expr(f"{name}({p}) within group (order by `{value}`)").alias(n) for n, p in probs.items()]
        )
    cum = cumulative_counts(df, keys, value, hot_rows)
    totals = cum.groupBy(*keys).agg(F.sum("n").alias("_total"))
    ranked = same_keys(cum, totals, keys)
    aggs = []
    for n, p in probs.items():
        if discrete:
            target = F.greatest(F.ceil(F.col("_total") * F.lit(float(p))) - 1, F.lit(0))
        else:
            target = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(target), F.ceil(target)

        def at(rank: Column) -> Column:
            return (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))

        aggs.append(F.max(F.when(at(low), F.col(value))).alias(f"_lo_{n}"))
        aggs.append(F.max(F.when(at(high), F.col(value))).alias(f"_hi_{n}"))
        aggs.append(F.max(target - low).alias(f"_w_{n}"))
    picked = ranked.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") if discrete else F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ],
    )


def scalar(df: DataFrame) -> Column:
    """The single value of a one-row, one-column frame as an expression.

    A scalar subquery: evaluated once and folded into the outer plan as a
    literal, with no join.
    """
    return df.scalar()
