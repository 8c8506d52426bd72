"""Streams in several batches give what a batch job gives."""

import uuid

import pytest
from pyspark.sql import functions as F

from fieldloom.plans.tables import BASE
from fieldloom.sources.mergetable import MergeTable
from fieldloom.streaming import flows
from tests.conftest import rows


@pytest.fixture(scope="module")
def folder(tables, tmp_path_factory):
    """Events split into four files in time order, one batch each; every 50th event is sent again a day later."""
    path = str(tmp_path_factory.mktemp("events"))
    e = tables.events
    cuts = ["2024-01-01", "2024-01-09", "2024-01-16", "2024-01-23", "2024-02-01"]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = e.where((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")))
        part.coalesce(1).write.parquet(f"{path}/{i}")
    return path


@pytest.fixture
def stream(spark, folder):
    def make():
        return (
            spark.readStream.schema(BASE["events"]).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
            .select("event_id", F.col("event_type").alias("variable"), "value", "ts", F.col("user_id").alias("station"))
        )

    return make


def name():
    return f"t-{uuid.uuid4().hex}"


def test_anomaly_state_spans_batches(spark, tables, stream):
    from fieldloom.session import shared_dir

    path = f"{shared_dir(spark)}/{name()}"
    query = flows.run_batches(stream(), name(), flows.anomaly_sink(path, "variable STRING", ["variable"], "value", ["ts", "event_id"], k=2.0, centre=40.0))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    got = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
    want = flows.running_anomalies(tables.observations, ["variable"], "value", [F.col("ts"), F.col("event_id")], None, 2.0, centre=40.0)
    assert rows(got, "event_id", "severity") == rows(want, "event_id", "severity") and want.count() > 0
    chunked = flows.running_anomalies(tables.observations, ["variable"], "value", [F.col("ts"), F.col("event_id")], None, 2.0, centre=40.0, hot_rows=100)
    assert rows(chunked, "event_id", "severity") == rows(want, "event_id", "severity")
    # the state is one row per key
    state = spark.read.parquet(f"{path}/state/batch={flows.versions(spark, f'{path}/state')[-1]}")
    assert state.count() == 5 and state.agg(F.sum("n")).first()[0] == tables.events.count()


def test_windows_over_batches(tables, stream):
    table, _ = flows.run_to_table(flows.tumbling(stream(), ["variable"], "value", "1 day", delay="1 hour"), name())
    want = tables.observations.groupBy(F.date_trunc("day", "ts").alias("start_ts"), "variable").agg(F.count(F.lit(1)).alias("n"))
    last = tables.events.agg(F.max("ts")).first()[0]
    closed = want.where(F.col("start_ts") + F.expr("INTERVAL 25 HOURS") <= F.lit(last))
    assert rows(table, "start_ts", "variable", "n") == rows(closed, "start_ts", "variable", "n")


def test_late_rows_are_dropped_and_counted(spark, tables, tmp_path):
    """Lateness is judged by the watermark of the batch before: the third file's old rows are beyond it."""
    e = tables.observations
    late, end = F.col("event_id") % 97 == 0, F.col("ts") >= F.lit("2024-01-30").cast("timestamp")
    for i, part in enumerate((e.where(~late & ~end), e.where(~late & end), e.where(late))):
        part.coalesce(1).write.parquet(str(tmp_path / str(i)))
    df = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    table, query = flows.run_to_table(flows.tumbling(df, ["variable"], "value", "1 hour"), name())
    dropped = flows.dropped_late_rows(query)
    assert dropped > 0
    assert table.agg(F.sum("n")).first()[0] <= e.count() - dropped


def test_duplicates_across_batches(spark, tables, tmp_path):
    e = tables.observations
    e.coalesce(1).write.parquet(str(tmp_path / "0"))
    e.where("event_id % 50 = 0 AND ts > TIMESTAMP '2024-01-29 12:00:00'").coalesce(1).write.parquet(str(tmp_path / "1"))
    df = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    table, _ = flows.run_to_table(flows.dedupe(df, delay="5 days"), name())
    assert table.count() == e.count()


def test_upsert_replay_gives_the_same_table(spark, tmp_path):
    schema = "k INT, v STRING, o INT"
    sink = flows.upsert_sink(str(tmp_path / "t"), schema, ["k"], None, ["o"])

    def batch(*data):
        return spark.createDataFrame(list(data), schema)

    sink(batch((1, "a", 1), (2, "b", 1)), 0)
    sink(batch((1, "c", 2)), 1)
    sink(batch((1, "c", 2)), 1)
    assert rows(flows.latest(spark, str(tmp_path / "t"), schema, ["k"], ["o"]), "k", "v") == [(1, "c"), (2, "b")]
    assert flows.latest(spark, str(tmp_path / "none"), schema, ["k"], ["o"]).count() == 0


def test_rows_that_come_late_do_not_replace_newer_ones(spark, tmp_path):
    schema = "k INT, v STRING"
    path = str(tmp_path / "late")
    sink = flows.upsert_sink(path, schema, ["k"], ["v"], ["o"])

    def batch(*data):
        return spark.createDataFrame(list(data), "k INT, v STRING, o INT")

    sink(batch((1, "new", 9), (2, "x", 1)), 0)
    sink(batch((1, "stale", 2), (2, "y", 1), (3, "z", None)), 1)
    sink(batch((3, "first", 0), (1, "older", 8)), 2)
    sink(batch((3, "late", -1)), 3)
    assert rows(flows.latest(spark, path, schema, ["k"], ["o"], ["v"]), "k", "v") == [(1, "new"), (2, "y"), (3, "first")]
    assert MergeTable(spark, path, schema, ["k"], ["o"], ["v"]).snapshots() == [2, 3]


def test_bad_json_goes_to_rejects(spark):
    raw = spark.createDataFrame([('{"event_id": 1, "event_type": "a", "value": 2.5}',), ("{broken",), ('{"event_type": "a"}',), (None,)], "value string")
    parsed = flows.parse_envelopes(raw)
    assert rows(flows.good_envelopes(parsed), "event_id", "value") == [(1, 2.5)] and flows.bad_envelopes(parsed).count() == 3


def test_a_failing_batch_is_tried_again(stream):
    calls = []

    def each(batch, number):
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("busy")

    flows.run_batches(stream(), name(), each)
    assert calls == [0, 0, 1, 2, 3]


def test_open_alerts(spark):
    from datetime import datetime

    anomalies = spark.createDataFrame([(1, "v", datetime(2024, 1, 1), 5.0, "critical"), (2, "v", datetime(2024, 1, 1), 3.1, "high")],
                                      "event_id long, variable string, ts timestamp, score double, severity string")
    rules = spark.createDataFrame([("v", 4.0, 2)], "variable string, min_score double, hours int")
    table = flows.alerts(anomalies, rules)
    assert rows(table, "alert_id", "valid_until") == [("alert-1", datetime(2024, 1, 1, 2))]
    assert flows.open_alerts(table, F.lit("2024-01-01 03:00:00").cast("timestamp")).count() == 0
