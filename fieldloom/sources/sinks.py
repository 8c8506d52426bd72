"""Tables that are changed: upsert, keyed objects, time partitions, retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(
    stored: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str] | None, order: Sequence[str], newest: bool = False
) -> DataFrame:
    """Stored rows with the changes applied: listed columns replaced, unknown keys added.

    ``update=[]`` does nothing on a conflict, ``None`` replaces every column. Of
    several changes to one key the last by ``order`` counts (an aggregate, so
    a key changed very often is combined before the shuffle). With ``newest`` the
    stored rows hold the order columns too, and a change that is older than
    the stored row by them is left out.
    """
    columns = stored.columns
    update = [c for c in columns if c not in keys] if update is None else list(update)
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), F.struct(*order)).alias("_new"))
    both = stored.withColumn("_old", F.lit(True)).join(last, list(keys), "full_outer")
    changed, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    if newest:
        late = F.struct(*[F.col(c) for c in order]) > F.struct(*[F.col(f"_new.{c}").alias(c) for c in order])
        changed = changed & ~F.coalesce(is_old & late, F.lit(False))
    out = []
    for c in columns:
        if c in keys:
            out.append(F.col(c))
            continue
        take = changed if c in update else changed & ~is_old
        out.append(F.when(take, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def put_objects(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Objects (key, data, metadata, created_at, updated_at) after ``new`` is put; a put overwrites but keeps created_at."""
    return upsert(objects, new, ["key"], ["data", "metadata", "updated_at"], ["updated_at"])


def list_keys(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Keys with a prefix, sorted."""
    return objects.where(F.col("key").startswith(prefix)).select("key").orderBy("key")


def delete_objects(objects: DataFrame, keys: DataFrame) -> DataFrame:
    return objects.join(keys.select("key"), "key", "left_anti")


def get_object(objects: DataFrame, key: str) -> bytes:
    """Data of one key; a missing key is an error."""
    row = objects.where(F.col("key") == key).select("data").take(1)
    if not row:
        raise KeyError(key)
    return bytes(row[0]["data"])


def object_exists(objects: DataFrame, key: str) -> bool:
    return bool(objects.where(F.col("key") == key).limit(1).take(1))


def write_partitioned(df: DataFrame, path: str, ts: str, unit: str = "month", mode: str = "append") -> None:
    """Parquet folders by day, week, month or quarter; rows are placed by their own time.

    Rows of one bucket are spread over several tasks by a hash of the row's
    time, so one crowded bucket is not one task.
    """
    bucket = F.to_date(F.date_trunc(unit, F.col(ts)))
    spread = F.pmod(F.hash(ts), F.lit(8))
    df.withColumn("bucket", bucket).repartition("bucket", spread).write.mode(mode).partitionBy("bucket").parquet(path)


def read_partitioned(spark, path: str, schema: str, ts: str, start: str, end: str, unit: str = "month") -> DataFrame:
    """Rows of a time range; whole folders outside it are pruned."""
    df = spark.read.schema(f"{schema}, bucket DATE").parquet(path)
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    pruned = df.where(F.col("bucket").between(F.to_date(F.date_trunc(unit, low)), F.to_date(high)))
    return pruned.where(F.col(ts).between(low, high))


def retention_tiers(df: DataFrame, ts: str, now: datetime | Column, keep_days: int) -> DataFrame:
    """Rows younger than ``keep_days`` with ``tier``: hot 7 days, warm a year, cold ten years, then archive."""
    at = now if isinstance(now, Column) else F.lit(now)
    age = F.datediff(F.to_date(at), F.to_date(F.col(ts)))
    tier = F.when(age <= 7, "hot").when(age <= 365, "warm").when(age <= 3650, "cold").otherwise("archive")
    return df.where(age <= keep_days).withColumn("age_days", age).withColumn("tier", tier)
