"""Windows over ordered rows: training samples, sessions, histories, lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.scale import framed, running_sums, with_position


def training_samples(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, width: int, horizon: int,
    hot_rows: int | None = None,
) -> DataFrame:
    """Each start row with ``inputs`` (``width`` values) and the next ``horizon`` values as ``targets``."""

    def add(frame: DataFrame, w) -> DataFrame:
        return frame.withColumn("inputs", F.collect_list(value).over(w.rowsBetween(0, width - 1))).withColumn(
            "targets", F.collect_list(value).over(w.rowsBetween(width, width + horizon - 1))
        )

    full = (F.size("inputs") == width) & (F.size("targets") == horizon)
    return framed(df.where(F.col(value).isNotNull()), keys, order, add, after=width + horizon - 1, hot_rows=hot_rows).where(full)


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 200) -> DataFrame:
    """The latest ``n`` rows per key. The rank filter is pushed below the shuffle as a group limit."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def history(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hot_rows: int | None = None) -> DataFrame:
    """Rows with their 1-based place in their key's history."""
    return with_position(df, keys, order, "place", hot_rows)


def live_latest(df: DataFrame, key: str, value: str, created: Sequence[str], expires: str, at: Column) -> DataFrame:
    """Latest value per key among the entries not expired at ``at``."""
    live = df.where(F.col(expires).isNull() | (F.col(expires) >= at))
    return live.groupBy(key).agg(F.max_by(value, F.struct(*created)).alias(value), F.count(F.lit(1)).alias("live"))


def smooth(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, rows: int = 20, hot_rows: int | None = None
) -> DataFrame:
    """Moving average at the positions that have a full window behind them."""

    def add(frame: DataFrame, w) -> DataFrame:
        w = w.rowsBetween(-(rows - 1), 0)
        return frame.withColumn("smoothed", F.avg(value).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))

    return framed(df, keys, order, add, before=rows - 1, hot_rows=hot_rows).where(F.col("_n") == rows).drop("_n")


def lags(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str], depth: int,
    hot_rows: int | None = None,
) -> DataFrame:
    """Columns ``{name}_lag{i}`` for i = 1..depth."""

    def add(frame: DataFrame, w) -> DataFrame:
        return frame.select(
            "*", *[F.lag(c, i).over(w).alias(f"{c}_lag{i}") for c in columns for i in range(1, depth + 1)]
        )

    return framed(df, keys, order, add, before=depth, hot_rows=hot_rows)


def sessions(
    df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str, gap_seconds: float, hot_rows: int | None = None
) -> DataFrame:
    """Rows with ``session`` (1-based per key): a new one after a pause longer than the gap."""
    order = [F.col(ts), F.col(tiebreak)]

    def add(frame: DataFrame, w) -> DataFrame:
        pause = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
        return frame.withColumn("_new", F.coalesce((pause > gap_seconds * 1_000_000).cast("long"), F.lit(1).cast("long")))

    marked = framed(df, keys, order, add, before=1, hot_rows=hot_rows)
    return running_sums(marked, keys, order, {"session": F.col("_new")}, hot_rows=hot_rows).drop("_new")


def ranking(df: DataFrame, key: str, score: str, hot_rows: int | None = None) -> DataFrame:
    """Keys by mean score, best first, with their place."""
    means = df.groupBy(key).agg(F.avg(score).alias("mean_score"))
    return with_position(means, [], [F.desc("mean_score"), F.asc(key)], "place", hot_rows)
