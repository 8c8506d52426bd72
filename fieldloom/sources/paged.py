"""Paged sources as a Spark data source: ``spark.read.format("paged")``.

Options: ``url`` (a folder of landed page files, on any file system that Arrow
reads), ``paging`` (offset, page or cursor), ``max_items``. Offset and page
paging are planned as one partition per run of pages and read in parallel; a
cursor chain is read by one task, because each page names the next.

A page is the folder ``page=<n>`` with one or more JSON documents, each with
``results``, ``total`` and ``next``; its records are those of all its files in
the order of their names. How many records a page holds is what page 0 holds,
and ``total`` says how many there are: a page with fewer or more, or a page
that is not there, is an error, so no record is lost.

As a stream (``stream_paged``) the source is followed while it grows: an offset
is the number of records seen, so a last page that fills up later gives its new
records only, and a restarted query goes on from its checkpoint. Cursor chains
have no numbers and cannot be streamed.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

#: pages that one task lands, about
LANDED_PER_TASK = 32
#: pages that one task reads at least, and tasks that read a source at most, where ``pages_per_task`` is not given
READ_PER_TASK, READ_TASKS = 16, 2000
KM_PER_DEGREE = 111.32  # fixed value: kilometres of one degree used for the radius of a box


def request_parameters(
    dialect: str, bbox: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None,
    max_cloud: float | None = None,
) -> dict[str, str]:
    """A box (min_lon, min_lat, max_lon, max_lat) and a time range in a source's own parameters."""
    out: dict[str, str] = {}
    if bbox is not None:
        w, s, e, n = bbox
        if dialect == "station":
            out["extent"] = f"{s},{w},{n},{e}"
        elif dialect == "occurrence":
            out["geometry"] = f"POLYGON(({w} {s},{e} {s},{e} {n},{w} {n},{w} {s}))"
        elif dialect == "air":
            out["coordinates"] = f"{(s + n) / 2},{(w + e) / 2}"
            out["radius"] = str(int(math.hypot(n - s, e - w) * KM_PER_DEGREE / 2 * 1000))
        else:
            out["bbox"] = f"{w},{s},{e},{n}"
    if dialect == "stac" and (start or end):
        out["datetime"] = f"{start or '..'}/{end or '..'}"
    elif dialect == "occurrence" and (start or end):
        out["eventDate"] = f"{start or '*'},{end or '*'}"
    else:
        if start:
            out["startdate" if dialect == "station" else "date_from"] = start
        if end:
            out["enddate" if dialect == "station" else "date_to"] = end
    if max_cloud is not None:
        out["eo:cloud_cover"] = f"<={max_cloud}"
    return out


class PageRange(InputPartition):
    """Pages first..last of a numbered source, or a cursor chain from its first page."""

    def __init__(self, first: int, last: int, chain: bool, size: int = 0, total: int = 0):
        super().__init__((first, last, chain))
        self.first, self.last, self.chain, self.size, self.total = first, last, chain, size, total


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        url = options["url"]
        self.url = f"file://{url[5:]}" if re.match("file:/(?!/)", url) else url
        self.paging = options.get("paging", "offset")
        self.max_items = int(options.get("max_items", "0"))
        self.per_task = int(options.get("pages_per_task", "0"))
        self.pushed: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons on scalar fields are applied while a page is read; the rest go back to Spark."""
        ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        names = {f.name: f.dataType.typeName() for f in self.schema.fields}
        for f in filters:
            if type(f) in ops and len(f.attribute) == 1 and names.get(f.attribute[0]) in ("long", "integer", "double", "string"):
                self.pushed.append((f.attribute[0], ops[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.paging == "cursor":
            return [PageRange(0, 0, True)]
        first = self._page(0)
        size, total = len(first["results"]), int(first["total"])
        wanted = min(total, self.max_items) if self.max_items else total
        if wanted and not size:
            raise ValueError(f"page 0 of {self.url} is empty, though there are {total} records")
        pages = math.ceil(wanted / size) if size else 0
        step = self.pages_of_task(pages)
        return [PageRange(i, min(i + step, pages), False, size, total) for i in range(0, pages, step)]

    def pages_of_task(self, pages: int) -> int:
        """Pages of one task: a task costs as much as many pages, so a long source has more of them in each."""
        return self.per_task or max(READ_PER_TASK, math.ceil(pages / READ_TASKS))

    def read(self, partition: PageRange) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]
        number, taken = partition.first, 0
        while True:
            if not partition.chain and number >= partition.last:
                return
            page = self._page(number)
            if not partition.chain:
                due = min(partition.size, partition.total - number * partition.size)
                if len(page["results"]) != due:
                    raise ValueError(f"page {number} of {self.url} has {len(page['results'])} records, not {due}")
            left = None
            if self.max_items:
                left = self.max_items - (taken if partition.chain else number * partition.size)
            for record in page["results"][: left if left is None else max(left, 0)]:
                taken += 1
                if self._matches(record):
                    yield tuple(record.get(n) for n in names)
            if partition.chain:
                if page.get("next") is None or (self.max_items and taken >= self.max_items):
                    if not self.max_items and page.get("total") is not None and taken != int(page["total"]):
                        raise ValueError(f"{self.url} has {taken} records, not {page['total']}")
                    return
                number = int(page["next"])
            else:
                number += 1

    def _matches(self, record: dict) -> bool:
        for name, op, value in self.pushed:
            have = record.get(name)
            if have is None:
                return False
            ok = {"=": have == value, ">": have > value, ">=": have >= value, "<": have < value, "<=": have <= value}[op]
            if not ok:
                return False
        return True

    def landed(self) -> int:
        """How many pages are there, counted from page 0 up to the first gap."""
        store, base = arrow_fs.FileSystem.from_uri(self.url)
        found = store.get_file_info(arrow_fs.FileSelector(base, allow_not_found=True))
        numbers = {int(f.base_name[5:]) for f in found if re.fullmatch(r"page=\d+", f.base_name)}
        return next(n for n in range(len(numbers) + 1) if n not in numbers)

    def _page(self, number: int) -> dict:
        store, base = arrow_fs.FileSystem.from_uri(self.url)
        found = store.get_file_info(arrow_fs.FileSelector(f"{base}/page={number}", allow_not_found=True))
        files = sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
        if not files:
            raise FileNotFoundError(f"page {number} of {self.url}")
        documents = []
        for path in files:
            with store.open_input_stream(path) as stream:
                documents.append(json.loads(stream.read()))
        told = {k: next((d[k] for d in documents if d.get(k) is not None), None) for k in ("total", "next")}
        return told | {"results": [record for d in documents for record in d["results"]]}


class RecordRange(InputPartition):
    """Records start..end of a numbered source with ``size`` records on each full page."""

    def __init__(self, start: int, end: int, size: int):
        super().__init__((start, end))
        self.start, self.end, self.size = start, end, size


class PagedStreamReader(DataSourceStreamReader):
    """Follows a numbered source to which records are only ever added at the end.

    A batch is planned from two record numbers and the size of page 0, so a repeated batch reads the same records. Page 0
    is full as soon as page 1 is there. The driver reads page 0 and the last page of a trigger, the tasks all others.
    """

    def __init__(self, schema: StructType, options: dict[str, str]):
        if options.get("paging", "offset") == "cursor" or options.get("max_items"):
            raise ValueError("a stream of pages needs numbered pages and takes no max_items")
        self.pages = PagedReader(schema, options)
        self.names = [f.name for f in schema.fields]

    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        last = self.pages.landed() - 1
        if last < 0:
            return {"records": 0}
        size = len(self.pages._page(0)["results"])
        return {"records": last * size + len(self.pages._page(last)["results"]) if last else size}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, stop = int(start["records"]), int(end["records"])
        if stop < first:
            raise ValueError(f"{self.pages.url} has {stop} records, but {first} were read before")
        if stop == first:
            return []
        size = max(1, len(self.pages._page(0)["results"]))
        step = size * self.pages.pages_of_task(-(-(stop - first) // size))
        cuts = [first, *range((first // step + 1) * step, stop, step), stop]
        return [RecordRange(a, b, size) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: RecordRange) -> Iterator[tuple]:
        size = partition.size
        for number in range(partition.start // size, -(-partition.end // size)):
            at = number * size
            due = min(size, partition.end - at)
            results = self.pages._page(number)["results"]
            if len(results) < due:
                raise ValueError(f"page {number} of {self.pages.url} has {len(results)} records, not {due}")
            for record in results[max(0, partition.start - at) : due]:
                yield tuple(record.get(n) for n in self.names)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> PagedStreamReader:
        return PagedStreamReader(schema, dict(self.options))


def land_pages(df, path: str, order: list, page_size: int) -> None:
    """Write rows as numbered page files (one JSON document a page), as a landing job does."""
    from pyspark.sql import functions as F

    from fieldloom.operators.scale import with_position

    total = df.count()
    tasks = max(1, min(READ_TASKS, math.ceil(total / page_size / LANDED_PER_TASK)))
    placed = with_position(df, [], order, "_pos").withColumn("page", F.floor((F.col("_pos") - 1) / page_size))
    # a page is a folder, which takes longer to make than its rows: the pages are dealt by their number, not by their bytes
    body = placed.repartition(tasks, "page").groupBy("page").agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.struct(*df.columns).alias("r")))).alias("_rows")
    ).withColumn("_total", F.lit(total).cast("long"))
    doc = F.to_json(F.struct(
        F.transform("_rows", lambda x: x["r"]).alias("results"), F.col("_total").alias("total"),
        F.when((F.col("page") + 1) * page_size < F.col("_total"), F.col("page") + 1).alias("next"),
    ))
    body.select("page", doc.alias("value")).write.mode("overwrite").partitionBy("page").text(path)


def read_paged(spark, schema: str, **options: str):
    """Register the source and read it with filter pushdown on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").schema(schema).options(**options).load()


def stream_paged(spark, schema: str, **options: str):
    """The source as a stream of the records that are added to it. Filters are applied behind the source."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").schema(schema).options(**options).load()
