import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import formats, paged, pages, sinks, transforms
from tests.conftest import plan_of, rows


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    df = spark.range(95).select(F.col("id"), (F.col("id") % 7).alias("kind"), (F.col("id") * 1.5).alias("value"))
    paged.land_pages(df, path, [F.col("id")], 20)
    return path


SCHEMA = "id BIGINT, kind BIGINT, value DOUBLE"


@pytest.mark.parametrize("style", ["offset", "page", "cursor"])
def test_paging(spark, landed, style):
    df = paged.read_paged(spark, SCHEMA, url=landed, paging=style, pages_per_task="2")
    assert rows(df, "id") == sorted(((i,) for i in range(95)), key=repr)
    assert df.rdd.getNumPartitions() == (1 if style == "cursor" else 3)


@pytest.mark.parametrize("style,n", [("offset", 50), ("cursor", 50), ("offset", 20), ("cursor", 500)])
def test_max_items(spark, landed, style, n):
    df = paged.read_paged(spark, SCHEMA, url=landed, paging=style, max_items=str(n))
    assert df.count() == min(n, 95)


def test_filters_are_pushed_into_the_reader(spark, landed):
    df = paged.read_paged(spark, SCHEMA, url=landed).where("value >= 30 AND kind = 3 AND id + 1 > 0")
    assert rows(df, "id") == sorted(((i,) for i in range(95) if i * 1.5 >= 30 and i % 7 == 3), key=repr)


def test_reader_filters_by_itself():
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    reader = paged.PagedReader(StructType([StructField("a", LongType()), StructField("b", StringType())]), {"url": "x"})
    kept = list(reader.pushFilters([EqualTo(("a",), 1), GreaterThan(("b",), "m"), StringContains(("b",), "q")]))
    assert len(kept) == 1 and reader._matches({"a": 1, "b": "z"}) and not reader._matches({"a": 1}) and not reader._matches({"a": 1, "b": "a"})


def test_request_parameters():
    box = (-122.5, 37.7, -122.3, 37.9)
    assert paged.request_parameters("station", box)["extent"] == "37.7,-122.5,37.9,-122.3"
    assert paged.request_parameters("occurrence", box)["geometry"].startswith("POLYGON((-122.5 37.7,-122.3 37.7")
    air = paged.request_parameters("air", box, "a", "b")
    assert int(air["radius"]) == int(0.08**0.5 * 111.32 / 2 * 1000) and air["date_from"] == "a"
    assert paged.request_parameters("stac", None, None, "2024")["datetime"] == "../2024"
    assert paged.request_parameters("stac", None, max_cloud=20)["eo:cloud_cover"] == "<=20"


def page_set(spark):
    good, bad = {"id": 1, "v": 2.0}, {"id": 2, "v": None}
    data = [("valid", [good, {"id": 3, "v": 1.0}]), ("one bad record", [good, bad]), ("empty", []), ("duplicate", [good, {"id": 3, "v": 1.0}]), ("null", None)]
    return spark.createDataFrame(data, "page_id string, records array<struct<id: int, v: double>>")


def test_whole_pages_are_rejected(spark):
    good, bad = pages.validate_pages(page_set(spark), "records", ["id", "v"])
    assert rows(good, "page_id") == [("duplicate",), ("valid",)] and bad.count() == 3


def test_duplicate_pages(spark):
    df = page_set(spark).withColumn("checksum", F.sha2(F.to_json("records"), 256)).where("records IS NOT NULL")
    assert rows(pages.dedupe_pages(df, "page_id"), "page_id") == [("duplicate",), ("empty",), ("one bad record",)]
    seen = df.where("page_id = 'empty'")
    assert pages.dedupe_pages(df, "page_id", seen).count() == 2


def test_ingest_counts_stores_and_records_errors(spark, tmp_path):
    p, calls = page_set(spark), []

    def store(df):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        df.write.parquet(str(tmp_path / "out"))

    log = {r["stage"]: r for r in pages.ingest_batch(p, "s", "records", ["id", "v"], lambda d: d.where("v > 1.5"), store).collect()}
    assert len(calls) == 3 and log["store"]["ok"] and log["store"]["records"] == 2
    assert (log["fetch"]["records"], log["validate"]["records"], log["transform"]["records"]) == (5, 2, 2)
    dry = {r["stage"]: r["records"] for r in pages.ingest_batch(p, "s", "records", ["id", "v"], lambda d: d).collect()}
    assert dry["transform"] == 4 and dry["store"] == 0

    def broken(df):
        raise RuntimeError("down")

    failed = pages.ingest_batch(p, "s", "records", ["id", "v"], lambda d: d, broken).first()
    assert not failed["ok"] and "down" in failed["error"]


def test_container_kinds(spark, tmp_path):
    for name, head in (("a.nc", b"CDF\x01"), ("b.h5", b"\x89HDF\r\n"), ("c.grib", b"GRIB"), ("d.txt", b"hello")):
        (tmp_path / name).write_bytes(head + b"rest")
    got = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in formats.scan_containers(spark, str(tmp_path)).collect()}
    assert got == {"a.nc": "netcdf3", "b.h5": "hdf5", "c.grib": "grib", "d.txt": None}


def test_geojson(spark, tmp_path):
    f = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"name": "x", "n": 3}}
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [f, f]}, indent=1))
    df = formats.read_table(spark, "geojson", str(tmp_path / "f.geojson"), "name STRING, n INT")
    assert [(r["name"], r["n"], r["geometry_type"], json.loads(r["coordinates"])) for r in df.collect()] == [("x", 3, "Point", [1.5, 2])] * 2
    with pytest.raises(ValueError):
        formats.read_table(spark, "zarr", "x", "a INT")


def test_station_flags_and_units(spark):
    data = [
        ("2024-01-01T00:00:00", "TMAX", 255.0, "s", "3,,W"), ("2024-01-01T00:00:00Z", "AWND", 7.0, "s", ""), ("2024-01-01T00:00:00", "SNOW", 1.0, "s", None),
        ("2024-01-01T00:00:00", "PRCP", 12.0, "unknown", None),
    ]
    records = spark.createDataFrame(data, "date string, datatype string, value double, station string, attributes string")
    stations = spark.createDataFrame([("s", 1.0, 2.0, 3.0)], "station string, latitude double, longitude double, elevation double")
    got = rows(transforms.station_records(records, stations), "variable", "value", "unit", "quality_flag")
    assert got == sorted([("temperature", 25.5, "°C", 3), ("wind_speed", 7.0, "m/s", 0)], key=repr)


def test_confidence_bounds(spark):
    data = [(None, None, None, 1.0), (20000.0, ["i"] * 10, None, 0.4), (5000.0, [], ["m"], 0.95), (None, [], ["m"], 1.0)]
    df = spark.createDataFrame(data, "u double, i array<string>, m array<string>, want double")
    for r in df.withColumn("got", transforms.occurrence_confidence(F.col("u"), F.col("i"), F.col("m"))).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_grid_stride_and_nan(spark):
    values = [[float(r * 1000 + c) for c in range(100)] for r in range(100)]
    values[2][4] = float("nan")
    df = spark.createDataFrame([("2m_temperature", 0, [float(i) for i in range(100)], [float(i) for i in range(100)], values), ("unknown", 0, [], [], [])],
                               "variable string, time int, lats array<double>, lons array<double>, values array<array<double>>")
    assert transforms.grid_records(df).count() == 100 * 100 - 1  # every cell, unless a stride is asked for
    out = transforms.grid_records(df, stride=2)
    assert out.count() == 50 * 50 - 1 and out.where("latitude % 2 <> 0 OR longitude % 2 <> 0").count() == 0
    assert out.where("latitude = 2 AND longitude = 6").first()["value"] == pytest.approx(2006 - 273.15)


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "x", 20, 1), (2, "y", 21, 2), (3, None, 3, 1)], "k int, s string, n int, o int")
    assert rows(sinks.upsert(old, new, ["k"], ["n"], ["o"])) == sorted([(1, "a", 1), (2, "b", 21), (3, None, 3)], key=repr)
    assert rows(sinks.upsert(old, new, ["k"], [], ["o"])) == sorted([(1, "a", 1), (2, "b", 2), (3, None, 3)], key=repr)
    assert rows(sinks.upsert(old, new, ["k"], None, ["o"])) == sorted([(1, "a", 1), (2, "y", 21), (3, None, 3)], key=repr)


def test_object_round_trip(spark):
    t = datetime(2024, 1, 1)
    schema = "key string, data binary, metadata map<string, string>, created_at timestamp, updated_at timestamp"
    objects = spark.createDataFrame([("test/key.txt", bytearray(b"hello world"), {"a": "b"}, t, t), ("other", bytearray(b"x"), {}, t, t)], schema)
    assert sinks.get_object(objects, "test/key.txt") == b"hello world" and not sinks.object_exists(objects, "missing")
    with pytest.raises(KeyError):
        sinks.get_object(objects, "missing")
    later = datetime(2024, 2, 1)
    put = sinks.put_objects(objects, spark.createDataFrame([("other", bytearray(b"y"), {}, later, later)], schema))
    row = put.where("key = 'other'").first()
    assert bytes(row["data"]) == b"y" and row["created_at"] == t and row["updated_at"] == later
    assert [r["key"] for r in sinks.list_keys(put, "test/").collect()] == ["test/key.txt"]
    assert sinks.delete_objects(put, put.where("key = 'other'")).count() == 1


def test_partitions_are_pruned(spark, tables, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_partitioned(tables.orders, path, "o_orderdate", "quarter")
    from fieldloom.plans.tables import BASE

    df = sinks.read_partitioned(spark, path, BASE["orders"], "o_orderdate", "1997-01-15", "1997-05-01", "quarter")
    assert "PartitionFilters: [isnotnull(bucket" in plan_of(df)
    files = {r["f"].split("bucket=")[1].split("/")[0] for r in df.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files == {"1997-01-01", "1997-04-01"}


def _page(folder, number, results, total, name="part.json"):
    (folder / f"page={number}").mkdir(exist_ok=True)
    (folder / f"page={number}" / name).write_text(json.dumps({"results": [{"id": i} for i in results], "total": total}))


def test_paged_counts_come_from_the_source(spark, tmp_path):
    for p in range(12):
        _page(tmp_path, p, range(10 * p, 10 * p + 6), 120, "a.json")
        _page(tmp_path, p, range(10 * p + 6, 10 * p + 10), 120, "b.json")
    for paging in ("offset", "page"):
        df = paged.read_paged(spark, "id BIGINT", url=str(tmp_path), paging=paging, pages_per_task="3")
        assert sorted(r.id for r in df.collect()) == list(range(120))


@pytest.mark.parametrize("fault", ["short", "missing"])
def test_paged_losses_are_errors(spark, tmp_path, fault):
    for p in range(3 if fault == "short" else 2):
        _page(tmp_path, p, range(5 * p, 5 * p + (4 if p == 1 and fault == "short" else 5)), 15)
    with pytest.raises(Exception, match="page 1|page 2"):
        paged.read_paged(spark, "id BIGINT", url=str(tmp_path)).collect()


def test_paged_stream_follows_a_growing_source(spark, tmp_path):
    from fieldloom.streaming import flows

    url, seen = tmp_path / "pages", []
    (tmp_path / "pages").mkdir()

    def run():
        df = paged.stream_paged(spark, "id BIGINT", url=str(url), pages_per_task="2")
        table, _ = flows.run_to_table(df, f"follow-{tmp_path.name}-{id(seen)}")
        return sorted(r.id for r in table.collect())

    assert run() == []
    _page(url, 0, [0, 1], 2)
    assert run() == [0, 1]
    _page(url, 0, range(4), 11)
    _page(url, 1, range(4, 8), 11)
    _page(url, 2, range(8, 11), 11)
    _page(url, 4, range(16, 20), 20)
    assert run() == list(range(11)) == run()
    _page(url, 2, range(8, 12), 30)
    _page(url, 3, range(12, 16), 30)
    assert run() == list(range(20))


def test_paged_stream_faults(tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("id", LongType())])
    for options in ({"paging": "cursor"}, {"max_items": "3"}):
        with pytest.raises(ValueError):
            paged.PagedStreamReader(schema, {"url": str(tmp_path), **options})
    _page(tmp_path, 0, range(4), 9)
    _page(tmp_path, 1, range(4, 7), 9)
    _page(tmp_path, 2, range(8, 9), 9)
    reader = paged.PagedStreamReader(schema, {"url": str(tmp_path), "pages_per_task": "1"})
    end = reader.latestOffset()
    parts = reader.partitions({"records": 2}, end)
    assert end == {"records": 9} and [(p.start, p.end) for p in parts] == [(2, 4), (4, 8), (8, 9)]
    assert list(reader.read(parts[0])) == [(2,), (3,)]
    with pytest.raises(ValueError, match="page 1"):
        list(reader.read(parts[1]))
    with pytest.raises(ValueError, match="were read before"):
        reader.partitions({"records": 10}, end)
    assert reader.partitions(end, end) == []


def test_pages_are_landed_by_many_tasks_and_a_long_source_is_read_in_longer_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paged, "LANDED_PER_TASK", 4)
    path = str(tmp_path / "many")
    paged.land_pages(spark.range(203), path, [F.col("id")], 5)
    writers = {f.name.split("-")[1] for f in (tmp_path / "many").glob("page=*/part-*")}
    assert len(writers) > 3 and len(list((tmp_path / "many").glob("page=*/part-*"))) == 41
    assert sorted(r[0] for r in paged.read_paged(spark, "id BIGINT", url=path).collect()) == list(range(203))

    def runs(**options):
        return [(p.first, p.last) for p in paged.PagedReader(spark.range(1).schema, {"url": path, **options}).partitions()]

    assert runs() == [(0, 16), (16, 32), (32, 41)] and len(runs(pages_per_task="1")) == 41
    monkeypatch.setattr(paged, "READ_TASKS", 2)
    assert runs() == [(0, 21), (21, 41)]
    empty = str(tmp_path / "none")
    paged.land_pages(spark.range(0), empty, [F.col("id")], 5)
    assert not list((tmp_path / "none").glob("page=*"))
