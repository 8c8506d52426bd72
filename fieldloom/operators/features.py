"""A point-in-time feature store on date-partitioned Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.aggregates import last_non_null
from fieldloom.operators.filters import filter_entities, filter_time
from fieldloom.operators.joins import join_feature_outer
from fieldloom.operators.scale import carry_forward, framed

REGISTRY = "name STRING, entity STRING, ts STRING, seq STRING, features ARRAY<STRING>, description STRING, tags ARRAY<STRING>"


class FeatureStore:
    """Feature sets under one shared folder: a registry table, and one table per set in folders by ``unit`` of time.

    A store must always be opened with the unit that it was filled with.
    """

    def __init__(self, spark: SparkSession, path: str, unit: str = "day"):
        self.spark, self.path, self.unit = spark, path.rstrip("/"), unit

    def register(self, name: str, entity: str, ts: str, features: Sequence[str] = (), description: str = "", tags: Sequence[str] = (), seq: str | None = None) -> None:
        """``seq`` names a number that orders rows of one entity and time; without it their order is by chance."""
        row = [(name, entity, ts, seq, list(features), description, list(tags))]
        self.register_all(self.spark.createDataFrame(row, REGISTRY))

    def register_all(self, definitions: DataFrame) -> None:
        """Register every row of ``definitions``, which has columns of the registry; missing ones are null or empty."""
        known = self.spark.createDataFrame([], REGISTRY).schema
        empty = {"features": F.array().cast("array<string>"), "tags": F.array().cast("array<string>"), "description": F.lit("")}
        columns = [F.col(f.name) if f.name in definitions.columns else empty.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in known]
        definitions.select(*columns).write.mode("append").parquet(f"{self.path}/_sets")

    def sets(self) -> DataFrame:
        return self.spark.read.schema(REGISTRY).parquet(f"{self.path}/_sets")

    def describe(self, name: str) -> dict[str, Any]:
        """Definition of one set; an unknown set is an error."""
        rows = self.sets().where(F.col("name") == name).limit(2).collect()
        if not rows:
            raise KeyError(f"feature set {name} is not registered")
        return rows[0].asDict()

    def ingest(self, name: str, df: DataFrame, now: datetime | None = None) -> None:
        """Append rows; each is filed under its own time. A missing timestamp is ``now``."""
        d = self.describe(name)
        stamp = F.lit(now) if now is not None else F.current_timestamp()
        ts = F.coalesce(F.col(d["ts"]), stamp) if d["ts"] in df.columns else stamp
        rows = df.withColumn(d["ts"], ts).withColumn("event_date", F.to_date(F.date_trunc(self.unit, d["ts"])))
        declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("event_date").schema)
        # the first ingest declares the columns; readers never infer them
        self.spark.createDataFrame([(declared,)], "ddl string").write.mode("ignore").parquet(f"{self.path}/_schemas/{name}")
        rows.hint("rebalance", F.col("event_date")).write.mode("append").partitionBy("event_date").parquet(f"{self.path}/{name}")

    def schema(self, name: str) -> str:
        return self.spark.read.schema("ddl string").parquet(f"{self.path}/_schemas/{name}").first()["ddl"]

    def rows(self, name: str, start: Any = None, end: Any = None) -> tuple[DataFrame, dict[str, Any]]:
        """Rows of a set in a time range; the dates outside it are pruned as folders."""
        d = self.describe(name)
        df = self.spark.read.schema(f"{self.schema(name)}, event_date DATE").parquet(f"{self.path}/{name}")
        if start is not None:
            df = df.where(F.col("event_date") >= F.to_date(F.date_trunc(self.unit, F.lit(start).cast("timestamp"))))
        if end is not None:
            df = df.where(F.col("event_date") <= F.to_date(F.lit(end)))
        return filter_time(df, start, end, d["ts"]).drop("event_date"), d

    def _columns(self, df: DataFrame, d: dict[str, Any]) -> list[str]:
        return list(d["features"]) or [c for c in df.columns if c not in (d["entity"], d["ts"], d["seq"])]

    @staticmethod
    def _order(d: dict[str, Any]) -> list[str]:
        return [d["ts"], d["seq"]] if d["seq"] else [d["ts"]]

    def get(self, name: str, at: Any, entities: Sequence[Any] | DataFrame | None = None) -> DataFrame:
        """Per entity the last non-null value of every feature at or before ``at``."""
        df, d = self.rows(name, end=at)
        if entities is not None:
            df = filter_entities(df, entities, d["entity"])
        columns = self._columns(df, d)
        return last_non_null(df, [d["entity"]], columns, self._order(d))

    def training(self, names: Sequence[str], start: Any, end: Any) -> DataFrame:
        """Sets joined outer on the entity within a time range."""
        parts: dict[str, DataFrame | None] = {}
        entity = None
        for name in names:
            df, d = self.rows(name, start, end)
            entity = entity or d["entity"]
            parts[name] = df.withColumnRenamed(d["entity"], entity)
        return join_feature_outer(parts, entity)

    def _history(self, names: Sequence[str], entity: str | None, taken: Sequence[str], end: Any = None) -> tuple[DataFrame, str, list[str]]:
        """All sets' rows under each other: entity, _t, _side (the set's number), _seq and the features of all sets, each
        under its own name or, where that is taken, with the suffix ``_{set}``; (rows, entity column, feature names)."""
        out, used = None, list(taken)
        for side, name in enumerate(names):
            df, d = self.rows(name, end=end)
            entity = entity or d["entity"]
            seq = F.col(d["seq"]).cast("long") if d["seq"] else F.lit(0).cast("long")
            columns = {c: f"{c}_{name}" if c in used else c for c in self._columns(df, d)}
            used += columns.values()
            part = df.select(F.col(d["entity"]).alias(entity), F.col(d["ts"]).alias("_t"), F.lit(side).alias("_side"), seq.alias("_seq"), *[F.col(c).alias(f"_f_{o}") for c, o in columns.items()])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out, entity, used[len(taken) :]

    def training_at(self, labels: DataFrame, names: str | Sequence[str], label_time: str, entity: str | None = None, hot_rows: int | None = None) -> DataFrame:
        """Label rows with the last known value of every feature of one or several sets at their time.

        The histories of all sets and the labels are merged along time in one ordered pass, in chunks where an entity has
        very many rows; no set is joined with another. A feature whose name the labels or an earlier set have gets the
        suffix ``_{set}``. ``entity`` is the labels' entity column, by default that of the first set.
        """
        names = [names] if isinstance(names, str) else list(names)
        entity = entity or self.describe(names[0])["entity"]
        history, entity, features = self._history(names, entity, labels.columns)
        own = [c for c in labels.columns if c != entity]
        asked = labels.select(entity, F.col(label_time).alias("_t"), F.lit(len(names)).alias("_side"), F.lit(0).cast("long").alias("_seq"), F.struct(*own).alias("_row"))
        stacked = history.unionByName(asked, allowMissingColumns=True)
        order = [F.col("_t"), F.col("_side"), F.col("_seq")]
        carried = carry_forward(stacked, [entity], order, {c: F.col(f"_f_{c}") for c in features}, hot_rows=hot_rows)
        return carried.where(F.col("_side") == len(names)).select(entity, "_row.*", *features)

    def timeline(self, names: Sequence[str], start: Any, end: Any, hot_rows: int | None = None) -> DataFrame:
        """What was known of every entity from ``start`` to ``end``: a row for each interval [valid_from, valid_to) in which
        no set had a new row, with the last known value of every feature of all sets.

        The sets' histories are merged along time, not joined: the result has at most as many rows as they have together.
        Rows before ``start`` count for what is known at it.
        """
        history, entity, features = self._history(list(names), None, [], end)
        order = [F.col("_t"), F.col("_side"), F.col("_seq")]
        carried = carry_forward(history, [entity], order, {c: F.col(f"_f_{c}") for c in features}, hot_rows=hot_rows)
        last = carried.groupBy(entity, "_t").agg(F.max_by(F.struct(*features), F.struct("_side", "_seq")).alias("_known"))
        closed = framed(last, [entity], [F.col("_t")], lambda df, w: df.withColumn("_next", F.lead("_t").over(w)), after=1, hot_rows=hot_rows)
        low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
        kept = closed.where((F.col("_t") < high) & (F.col("_next").isNull() | (F.col("_next") > low)))
        return kept.select(entity, F.greatest("_t", low).alias("valid_from"), F.coalesce(F.least("_next", high), high).alias("valid_to"), "_known.*")

    def online(self, name: str) -> DataFrame:
        """(key, value): latest features per entity as JSON under ``features:{set}:{entity}``."""
        df, d = self.rows(name)
        columns = self._columns(df, d)
        latest = last_non_null(df, [d["entity"]], columns, self._order(d))
        return online_rows(latest, name, d["entity"], columns)


def online_rows(latest: DataFrame, name: str, entity: str, columns: Sequence[str]) -> DataFrame:
    return latest.select(
        F.concat(F.lit(f"features:{name}:"), F.col(entity).cast("string")).alias("key"), F.to_json(F.struct(*columns)).alias("value")
    )
