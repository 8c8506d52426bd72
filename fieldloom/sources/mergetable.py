"""A keyed table that grows by upserts: key buckets, deltas merged on reading, a manifest for each snapshot.

A commit writes the last change of each key of its batch, filed by bucket, and a manifest that names, for every bucket,
the folders that hold its rows. So what a commit writes is in proportion to its batch. A bucket with more than
``max_deltas`` folders is folded into one, and only that bucket. A reader takes one manifest and sees that snapshot,
whatever is committed meanwhile; it folds the rows of each key, newest by the order columns, on the fly.

Folders are named by commit and a random part, and count only when a manifest names them: what a lost writer left
behind is never read. A batch that is applied again is recognised by its number. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MergeTable:
    """``update`` names the columns that a newer change replaces (``None``: all but the keys); the others keep what the
    key's first commit gave. A change is newer if its ``order`` columns, which need not be columns of the table, are not
    below those of the stored row."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str], update: Sequence[str] | None = None,
        buckets: int = 16, max_deltas: int = 4,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.max_deltas = list(keys), list(order), max_deltas
        self.columns = spark.createDataFrame([], schema).columns
        others = [c for c in self.columns if c not in self.keys]
        self.update = others if update is None else list(update)
        self.first = [c for c in others if c not in self.update]
        self.marks = [f"_order{i}" for i in range(len(self.order))]
        have = self.snapshots()
        self.buckets = self.manifest(have[-1])["buckets"] if have else buckets

    # ---- manifests ------------------------------------------------------------------

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def snapshots(self) -> list[int]:
        """Numbers of the commits that can be read, ascending."""
        fs, root = self._fs(f"{self.path}/_snapshots")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, number: int) -> dict[str, Any]:
        """Of one snapshot: buckets, order types, parts (folders by bucket), written (bytes), folded (buckets)."""
        lines = self.spark.read.option("wholetext", True).text(f"{self.path}/_snapshots/{number:012d}.json").collect()
        return json.loads(lines[0][0])

    def _publish(self, number: int, manifest: dict[str, Any]) -> None:
        """Manifests appear whole: they are written aside and renamed."""
        fs, aside = self._fs(f"{self.path}/_snapshots/_{number:012d}-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/_snapshots/{number:012d}.json")
        if fs.exists(final) or not fs.rename(aside, final):
            raise RuntimeError(f"another writer has committed {number}")

    # ---- reading --------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _parts(self, folders: list[str], marks: str) -> DataFrame:
        ddl = f"{self.schema}, {marks}_commit BIGINT"
        if not folders:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*[f"{self.path}/{f}" for f in folders])

    def _folded(self, rows: DataFrame) -> DataFrame:
        """One row a key, as if the commits had been applied one after the other."""
        newest = F.struct(*[F.col(m) for m in self.marks], F.col("_commit"))
        aggs = [F.min("_commit").alias("_commit"), F.max_by(F.struct(*[F.col(c) for c in (*self.update, *self.marks)]), newest).alias("_new")]
        if self.first:
            aggs.append(F.min_by(F.struct(*[F.col(c) for c in self.first]), "_commit").alias("_first"))
        out = rows.groupBy(*self.keys).agg(*aggs)
        of = {c: "_first" for c in self.first} | {c: "_new" for c in self.update}
        named = [F.col(f"{of[c]}.{c}").alias(c) if c in of else F.col(c) for c in self.columns]
        return out.select(*named, *[F.col(f"_new.{m}").alias(m) for m in self.marks], "_commit")

    def read(self, number: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of a snapshot (the last one); of some buckets only if named. A table without commits is empty."""
        have = self.snapshots()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        told = self.manifest(have[-1] if number is None else number)
        wanted = told["parts"] if buckets is None else {str(b): told["parts"].get(str(b), []) for b in buckets}
        folders = [f for parts in wanted.values() for f in parts]
        return self._folded(self._parts(folders, told["marks"])).select(*self.columns)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of the keys of ``wanted``: only their buckets are read (their numbers, not the keys, reach the driver)."""
        some = wanted.select(*self.keys).distinct()
        numbers = [r[0] for r in some.select(self._bucket().alias("b")).distinct().collect()]
        return self.read(buckets=numbers).join(some, self.keys, "left_semi")

    # ---- writing --------------------------------------------------------------------

    def _write(self, rows: DataFrame, number: int) -> tuple[dict[str, str], int]:
        """(folder by bucket, bytes) of rows filed by bucket; a crowded bucket is written by several tasks."""
        folder = f"data/{number:012d}-{uuid.uuid4().hex}"
        filed = rows.withColumn("bucket", self._bucket()).hint("rebalance", F.col("bucket"))
        filed.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, root = self._fs(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("bucket=")}, int(fs.getContentSummary(root).getLength())

    def _prepared(self, changes: DataFrame, number: int) -> tuple[DataFrame, str]:
        """(the last change of each key with the commit's number, DDL of the order columns)."""
        marked = changes.select(*self.columns, *[F.col(c).alias(m) for c, m in zip(self.order, self.marks, strict=True)])
        marks = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in marked.schema if f.name in self.marks)
        others = [c for c in marked.columns if c not in self.keys]
        last = marked.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.struct(*self.marks)).alias("_new"))
        rows = last.select(*[F.col(c) if c in self.keys else F.col(f"_new.{c}").alias(c) for c in marked.columns], F.lit(number).cast("long").alias("_commit"))
        return rows, marks

    def apply(self, changes: DataFrame, number: int | None = None, keep: int = 2) -> int:
        """Commit a batch of changes (the table's columns and the order columns) and return its snapshot's number.

        Of several changes to a key in one batch the last by order counts. A number that is committed already is left as
        it is. Snapshots before the last ``keep`` are removed, with the folders that only they name.
        """
        have = self.snapshots()
        if number is None:
            number = have[-1] + 1 if have else 0
        if have and number <= have[-1]:
            return number
        rows, marks = self._prepared(changes, number)
        before = self.manifest(have[-1])["parts"] if have else {}
        made, written = self._write(rows, number)
        parts = {b: list(before.get(b, [])) for b in {*before, *made}}
        for b, folder in made.items():
            parts[b].append(folder)
        crowded = [b for b in made if len(parts[b]) > self.max_deltas]
        if crowded:
            one, more = self._write(self._folded(self._parts([f for b in crowded for f in parts[b]], marks)), number)
            parts |= {b: [one[b]] for b in crowded}
            written += more
        self._publish(number, {"buckets": self.buckets, "marks": marks, "parts": parts, "written": written, "folded": sorted(map(int, crowded))})
        self.vacuum(keep)
        return number

    def vacuum(self, keep: int = 2) -> None:
        """Remove snapshots before the last ``keep``, and the folders that only they name."""
        have = self.snapshots()
        old, kept = have[:-keep], have[-keep:]
        if not old:
            return
        live = {f for n in kept for parts in self.manifest(n)["parts"].values() for f in parts}
        for n in old:
            for folder in {f for parts in self.manifest(n)["parts"].values() for f in parts} - live:
                fs, p = self._fs(f"{self.path}/{folder}")
                fs.delete(p, True)
            fs, p = self._fs(f"{self.path}/_snapshots/{n:012d}.json")
            fs.delete(p, False)


class RollupTable(MergeTable):
    """A continuous aggregate kept up to date: count, sum, least and greatest value by time bucket and keys.

    A commit adds the states of its own rows, filed by time bucket; a late row adds to its bucket's folder alone and
    nothing else is read or written. Reading folds the states of a bucket, and a bucket with many folders is folded.
    """

    def __init__(self, spark: SparkSession, path: str, key_ddl: str, keys: Sequence[str], value: str, ts: str = "ts", unit: str = "day", max_deltas: int = 4):
        self.value, self.ts, self.unit = value, ts, unit
        schema = f"bucket_ts TIMESTAMP, {key_ddl}, n BIGINT, total DOUBLE, min_value DOUBLE, max_value DOUBLE"
        super().__init__(spark, path, schema, ["bucket_ts", *keys], [], [], max_deltas=max_deltas)

    def _bucket(self) -> Column:
        return F.datediff(F.to_date("bucket_ts"), F.lit("1970-01-01").cast("date"))

    def _prepared(self, changes: DataFrame, number: int) -> tuple[DataFrame, str]:
        v = F.col(self.value)
        states = changes.withColumn("bucket_ts", F.date_trunc(self.unit, self.ts)).groupBy(*self.keys).agg(
            F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("min_value"), F.max(v).alias("max_value")
        )
        return states.select(*self.columns, F.lit(number).cast("long").alias("_commit")), ""

    def _folded(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.min("_commit").alias("_commit")
        )
