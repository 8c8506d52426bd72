"""A table of upserts: what commits write, what readers see."""

import random
from pathlib import Path

import pytest

from fieldloom.sources.mergetable import MergeTable, RollupTable
from tests.conftest import rows

SCHEMA = "k INT, v STRING, w STRING"


def make(spark, path, **kw):
    return MergeTable(spark, str(path), SCHEMA, ["k"], ["o"], **kw)


def batch(spark, *data):
    return spark.createDataFrame(list(data), "k INT, v STRING, w STRING, o INT")


def one_by_one(batches, update=("v", "w")):
    """The same commits applied row by row; of a batch, the last by order of each key."""
    table = {}
    for data in batches:
        last = {}
        for k, v, w, o in data:
            if k not in last or o >= last[k][2]:
                last[k] = (v, w, o)
        for k, (v, w, o) in last.items():
            if k not in table:
                table[k] = [v, w, o]
            elif o >= table[k][2]:
                table[k] = [v if "v" in update else table[k][0], w if "w" in update else table[k][1], o]
    return sorted((k, v, w) for k, (v, w, _) in table.items())


@pytest.mark.parametrize("update", [None, ["w"]])
def test_commits_as_one_by_one(spark, tmp_path, update):
    rnd = random.Random(5)
    batches = [[(k, f"v{n}-{k}", f"w{n}-{k}", rnd.randrange(1000) * 100 + n) for k in rnd.sample(range(60), 25)] for n in range(7)]
    table = make(spark, tmp_path / "t", update=update, buckets=4, max_deltas=2)
    for data in batches:
        table.apply(batch(spark, *data))
    assert rows(table.read(), "k", "v", "w") == sorted(one_by_one(batches, update or ("v", "w")), key=repr)
    again = make(spark, tmp_path / "t", update=update)  # the number of buckets is the table's own
    assert again.buckets == 4 and rows(again.read(), "k", "v", "w") == rows(table.read(), "k", "v", "w")


def test_a_commit_writes_its_batch_and_crowded_buckets_only(spark, tmp_path):
    table = make(spark, tmp_path / "t", buckets=8, max_deltas=2)
    table.apply(batch(spark, *[(k, "x" * 200, str(k), 0) for k in range(20_000)]))
    first = table.manifest(0)
    table.apply(batch(spark, (1, "a", "b", 1)))
    second = table.manifest(1)
    changed = [b for b in second["parts"] if second["parts"][b] != first["parts"].get(b)]
    assert len(changed) == 1 and second["written"] < first["written"] / 20 and second["folded"] == []
    table.apply(batch(spark, (1, "c", "d", 2)))
    third = table.manifest(2)
    assert third["folded"] == [int(changed[0])] and len(third["parts"][changed[0]]) == 1
    assert third["written"] < first["written"] / 4
    assert all(third["parts"][b] == first["parts"][b] for b in first["parts"] if b != changed[0])
    assert rows(table.lookup(spark.createDataFrame([(1,), (7,), (-5,)], "k INT")), "k", "v") == [(1, "c"), (7, "x" * 200)]


def test_readers_keep_their_snapshot(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    table.apply(batch(spark, (1, "a", "a", 0)))
    before = table.read()
    table.apply(batch(spark, (1, "b", "b", 1), (2, "n", "n", 0)))
    assert rows(before, "k", "v") == [(1, "a")] and rows(table.read(0), "k", "v") == [(1, "a")]
    assert rows(table.read(), "k", "v") == [(1, "b"), (2, "n")]


def test_unfinished_and_repeated_commits_change_nothing(spark, tmp_path):
    table = make(spark, tmp_path / "t")
    table.apply(batch(spark, (1, "a", "a", 0)), 3)
    table._write(table._parts([], "_order0 INT, ").unionByName(spark.createDataFrame([(1, "lost", "lost", 9, 4)], f"{SCHEMA}, _order0 INT, _commit BIGINT")), 4)
    table.apply(batch(spark, (1, "again", "again", 9)), 3)
    assert rows(table.read(), "k", "v") == [(1, "a")]
    table.apply(batch(spark), 4)
    assert rows(table.read(), "k", "v") == [(1, "a")] and table.snapshots() == [3, 4]
    with pytest.raises(RuntimeError):
        table._publish(4, {})


def test_old_folders_go(spark, tmp_path):
    table = make(spark, tmp_path / "t", buckets=1, max_deltas=1)
    for n in range(4):
        table.apply(batch(spark, (n, "v", "w", n), (None, f"null {n}", "w", n)))
    assert table.snapshots() == [2, 3]
    live = {f.split("/")[1] for n in (2, 3) for parts in table.manifest(n)["parts"].values() for f in parts}
    kept = {p.parent.parent.name for p in Path(tmp_path, "t", "data").glob("*/bucket=*/*.parquet")}
    assert live <= kept
    assert rows(table.read(), "k", "v") == [(0, "v"), (1, "v"), (2, "v"), (3, "v"), (None, "null 3")]


def test_a_late_row_reopens_its_bucket_alone(spark, tmp_path):
    table = RollupTable(spark, str(tmp_path / "r"), "k STRING", ["k"], "v", max_deltas=2)

    def rows_of(*data):
        return spark.createDataFrame(list(data), "day STRING, k STRING, v DOUBLE").selectExpr("cast(day AS TIMESTAMP) AS ts", "k", "v")

    table.apply(rows_of(("2024-01-01 05:00:00", "a", 1.0), ("2024-01-01 06:00:00", "a", 3.0), ("2024-01-02 00:00:00", "a", 5.0), ("2024-01-02 00:00:00", None, None)))
    first = table.manifest(0)["parts"]
    table.apply(rows_of(("2024-01-01 23:59:59", "a", -1.0)))
    second = table.manifest(1)["parts"]
    day = next(b for b in second if second[b] != first[b])
    assert len(second[day]) == 2 and all(second[b] == first[b] for b in first if b != day)
    table.apply(rows_of(("2024-01-01 01:00:00", "b", 2.0)))
    assert len(table.manifest(2)["parts"][day]) == 1 and table.manifest(2)["folded"] == [int(day)]
    got = table.read().selectExpr("date_format(bucket_ts, 'dd') AS d", "k", "n", "total", "min_value", "max_value")
    assert rows(got) == sorted([("01", "a", 3, 3.0, -1.0, 3.0), ("01", "b", 1, 2.0, 2.0, 2.0), ("02", "a", 1, 5.0, 5.0, 5.0), ("02", None, 1, None, None, None)], key=repr)
