"""Structured Streaming flows over event files: ingest, deduplicate, aggregate, detect, alert, join, upsert.

A file folder stands for the topic. Checkpoints, sinks and state tables live in
the shared folder, so a restarted query goes on where it stopped. Each batch of
a ``foreachBatch`` sink is written under its batch number: a repeated batch
replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from fieldloom.functions.scalar import severity_of_z
from fieldloom.operators.scale import running_sums, same_keys
from fieldloom.session import shared_dir
from fieldloom.sources.mergetable import MergeTable

ENVELOPE = "event_id BIGINT, event_type STRING, ts TIMESTAMP, source STRING, value DOUBLE"


def read_events(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the files of a folder, with a declared schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parse_envelopes(raw: DataFrame, body: str = "value", schema: str = ENVELOPE) -> DataFrame:
    """Columns of the JSON envelope beside ``body``; unreadable JSON, or one without an id, has null ``event``."""
    event = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    return raw.withColumn("event", event).withColumn("event", F.when(F.col("event.event_id").isNotNull(), F.col("event")))


def good_envelopes(parsed: DataFrame) -> DataFrame:
    return parsed.where("event IS NOT NULL").select("event.*")


def bad_envelopes(parsed: DataFrame, body: str = "value") -> DataFrame:
    return parsed.where("event IS NULL").select(body)


def dedupe(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each key once; keys are remembered for as long as the watermark allows."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def _stats(value: str) -> list[Column]:
    return [
        F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count(F.lit(1)).alias("n"),
    ]


def tumbling(events: DataFrame, keys: Sequence[str], value: str, length: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Continuous aggregate per window and key, emitted once the watermark has passed the window."""
    out = events.withWatermark(ts, delay).groupBy(F.window(ts, length), *keys).agg(*_stats(value))
    return out.select(F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), *keys, "avg_value", "min_value", "max_value", "n")


def sliding(events: DataFrame, keys: Sequence[str], value: str, length: str, slide: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Overlapping windows."""
    out = events.withWatermark(ts, delay).groupBy(F.window(ts, length, slide), *keys).agg(*_stats(value), F.stddev_samp(value).alias("std_value"))
    return out.select(F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), *keys, "avg_value", "std_value", "n")


def sessions(events: DataFrame, keys: Sequence[str], value: str, gap: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Activity sessions closed by a pause."""
    out = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), *keys, "n", "total")


def join_stations(readings: DataFrame, stations: DataFrame, key: str = "station") -> DataFrame:
    """Stream-static join: each batch reads the station table as it is then."""
    return readings.join(stations, key)


def join_in_bound(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, bound: str, delay: str = "1 hour") -> DataFrame:
    """Stream-stream join of rows with equal key, the right one at most ``bound`` after the left one."""
    a, b = left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay).withColumnRenamed(key, f"_{key}")
    cond = (F.col(key) == F.col(f"_{key}")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {bound}"))
    return a.join(b, cond).drop(f"_{key}")


# ---- running ----------------------------------------------------------------------


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, StreamingQuery]:
    """Run a stream over what is there now into a Parquet table; (the table, the finished query)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path), query


def run_batches(df: DataFrame, name: str, each: Callable[[DataFrame, int], None], tries: int = 3) -> StreamingQuery:
    """Run a stream through a batch function; a failing batch is tried again up to ``tries`` times."""

    def attempt(batch: DataFrame, number: int) -> None:
        for left in reversed(range(tries)):
            try:
                each(batch, number)
                return
            except Exception:
                if not left:
                    raise

    path = f"{shared_dir(df.sparkSession)}/{name}-checkpoint"
    query = df.writeStream.foreachBatch(attempt).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batch numbers that have a complete table under ``path``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
    return sorted(n for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}/_SUCCESS")))


def upsert_sink(path: str, schema: str, keys: Sequence[str], update: Sequence[str] | None, order: Sequence[str], buckets: int = 16, max_deltas: int = 4) -> Callable[[DataFrame, int], None]:
    """Batch function that merges rows into a ``MergeTable``: a batch writes its own rows and the buckets that it fills up.

    The table keeps each row's order, so a row that comes late, in whatever batch, does not replace a newer one. A
    repeated batch changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        MergeTable(batch.sparkSession, path, schema, keys, order, update, buckets, max_deltas).apply(batch, number)

    return each


def latest(spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Newest snapshot of an upserted table."""
    return MergeTable(spark, path, schema, keys, order, update).read()


# ---- anomalies ----------------------------------------------------------------------

STATE = "{key}, n BIGINT, s DOUBLE, q DOUBLE"


def running_anomalies(
    rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], prior: DataFrame | None, k: float = 3.0,
    warm_up: int = 10, centre: float = 0.0, hot_rows: int | None = None,
) -> DataFrame:
    """Rows further than k·std from the mean of the rows before them, in order, after ``warm_up`` rows.

    The running count, sum and sum of squares are ordered prefix sums, so a key
    with a third of the stream is cut into chunks like in a batch job. ``prior``
    (keys, n, s, q) carries what earlier batches have seen; ``centre`` is taken
    off the values first, so that squares of large values do not cancel.
    """
    v = F.col(value) - F.lit(centre)
    sums = running_sums(
        rows.where(F.col(value).isNotNull()), keys, order, {"_n": F.lit(1), "_s": v, "_q": v * v}, include_current=False, hot_rows=hot_rows
    )
    if prior is not None:
        sums = same_keys(sums, prior.withColumnsRenamed({"n": "_pn", "s": "_ps", "q": "_pq"}), keys, "left")
        sums = sums.withColumns({f"_{c}": F.col(f"_{c}") + F.coalesce(f"_p{c}", F.lit(0)) for c in ("n", "s", "q")}).drop("_pn", "_ps", "_pq")
    n = F.col("_n")
    mean = F.try_divide(F.col("_s"), n)
    var = F.try_divide(F.col("_q") - F.col("_s") * mean, n - 1)
    out = sums.withColumn("baseline", mean + F.lit(centre)).withColumn("spread", F.sqrt(F.greatest(var, F.lit(0.0))))
    score = F.try_divide(F.col(value) - F.col("baseline"), F.col("spread"))
    flagged = out.withColumn("score", score).where((n >= warm_up) & (F.abs("score") > k))
    return flagged.withColumn("severity", severity_of_z(F.col("score"))).drop("_n", "_s", "_q", "spread")


def anomaly_sink(
    path: str, key_ddl: str, keys: Sequence[str], value: str, order: Sequence[str], k: float = 3.0, warm_up: int = 10, centre: float = 0.0
) -> Callable[[DataFrame, int], None]:
    """Batch function: anomalies of the batch under ``path``/out, running moments per key under ``path``/state.

    The state is one small row per key, whatever has been seen.
    """
    schema = STATE.format(key=key_ddl)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, f"{path}/state") if v < number]
        prior = spark.read.schema(schema).parquet(f"{path}/state/batch={before[-1]}") if before else spark.createDataFrame([], schema)
        found = running_anomalies(batch, keys, value, [F.col(o) for o in order], prior, k, warm_up, centre)
        found.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        v = F.col(value) - F.lit(centre)
        new = batch.where(F.col(value).isNotNull()).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")
        )
        both = prior.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
        both.write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    return each


def alerts(anomalies: DataFrame, rules: DataFrame, ts: str = "ts") -> DataFrame:
    """Anomalies at or above their rule's score: alert with severity, valid_from and valid_until.

    ``rules`` (variable, min_score, hours) is a small table read per batch.
    """
    hit = anomalies.join(rules, "variable").where(F.abs("score") >= F.col("min_score"))
    return hit.select(
        F.concat_ws("-", F.lit("alert"), F.col("event_id").cast("string")).alias("alert_id"), "variable", "severity", F.col(ts).alias("valid_from"),
        F.timestamp_seconds(F.unix_seconds(ts) + F.col("hours") * 3600).alias("valid_until"), F.lit(False).alias("resolved"),
    )


def open_alerts(table: DataFrame, at: Column | None = None) -> DataFrame:
    """Unresolved alerts, those still valid when a time is given."""
    live = table.where("NOT resolved")
    return live if at is None else live.where(F.col("valid_until") >= at)


class LateRows(StreamingQueryListener):
    """Counts the rows that stateful operators dropped beyond the watermark, by query id, over all batches."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(int(s.numRowsDroppedByWatermark) for s in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows beyond the watermark that a finished query dropped, from the progress it still holds.

    A session keeps the last ``spark.sql.streaming.numRecentProgressUpdates`` batches only; when a query has run longer,
    this is an error, and a ``LateRows`` listener added before the start has the whole count.
    """
    recent = query.recentProgress
    if recent and int(recent[0]["batchId"]) > 0 and len(recent) >= int(_recent_kept()):
        raise ValueError("earlier batches are no longer held: add a LateRows listener before the query starts")
    return sum(int(state.get("numRowsDroppedByWatermark", 0)) for progress in recent for state in progress["stateOperators"])


def _recent_kept() -> str:
    return SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")
