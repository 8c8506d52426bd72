"""An inverted index of words as a table: posting blocks filed by word bucket, ids delta-coded.

A block holds up to ``BLOCK`` ascending ids of one word, with their bounds and number. The tasks that read the texts
gather the ids of each word and slot (a fixed range of ids) into lists, so that lists are shuffled, not single words. Blocks
are cut from lists that are range-partitioned on (bucket, word, slot), so a word that stands in every text is spread over
many tasks and many blocks.
A search reads the buckets of its words alone (partition pruning), in them the row groups of its words (the files are
sorted by word), and leaves blocks out whose bounds cannot matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.text import tokens
from fieldloom.session import shared_dir

#: ids of one block at most
BLOCK = 4096
#: rows (word, id) that one task gathers at a time
PENDING = 1 << 18
#: ids of one slot, the least part of a word that goes to one task, as a power of two
SLOT_BITS = 20
WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)
BLOCKS = "bucket INT, word STRING, first BIGINT, last BIGINT, n BIGINT, deltas BINARY"


def pack_ids(ids: np.ndarray) -> bytes:
    """Differences of ascending ids, in the narrowest of four widths, which the first byte names."""
    steps = np.diff(ids.astype(np.uint64))  # modulo 2^64, so any two signed ids have a difference
    widest = int(steps.max()) if len(steps) else 0
    code = next(i for i, w in enumerate(WIDTHS) if widest <= np.iinfo(w).max)
    return bytes([code]) + steps.astype(np.dtype(WIDTHS[code]).newbyteorder("<")).tobytes()


def unpack_ids(first: int, deltas: bytes) -> np.ndarray:
    steps = np.frombuffer(deltas, np.dtype(WIDTHS[deltas[0]]).newbyteorder("<"), offset=1).astype(np.uint64)
    start = np.array([first], np.int64).astype(np.uint64)
    return np.cumsum(np.concatenate([start, steps]), dtype=np.uint64).astype(np.int64)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, slot, ids) of rows (word, id): the ids of each word and slot among up to ``PENDING`` rows, ascending, each once."""
    held: list[pa.RecordBatch] = []

    def gathered() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        runs = rows.column(0).combine_chunks().dictionary_encode()
        codes, ids = np.asarray(runs.indices), np.asarray(rows.column(1))
        order = np.lexsort((ids, codes))
        codes, ids = codes[order], ids[order]
        new = np.concatenate([[True], (codes[1:] != codes[:-1]) | (ids[1:] != ids[:-1])])
        codes, ids = codes[new], ids[new]
        slots = ids >> SLOT_BITS
        starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (slots[1:] != slots[:-1])]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays([runs.dictionary.take(pa.array(codes[starts])), pa.array(slots[starts]), lists], names=["word", "slot", "ids"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PENDING:
            yield gathered()
            held = []
    if held:
        yield gathered()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (bucket, word, slot, ids) that arrive sorted; a word, and its last slot, may go on in the next batch."""
    schema = pa.schema([("bucket", pa.int32()), ("word", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("deltas", pa.binary())])
    held: tuple[int, str, np.ndarray] | None = None

    def cut(bucket: int, word: str, ids: np.ndarray, out: list) -> None:
        for at in range(0, len(ids), BLOCK):
            part = ids[at : at + BLOCK]
            out.append((bucket, word, int(part[0]), int(part[-1]), len(part), pack_ids(part)))

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column(1).dictionary_encode()
        codes, words = np.asarray(runs.indices), runs.dictionary.to_pylist()
        buckets, lists = np.asarray(batch.column(0)), batch.column(3)
        ids, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        out: list = []
        for a, b in zip(starts, np.append(starts[1:], len(codes)), strict=True):
            bucket, word, some = int(buckets[a]), words[codes[a]], ids[ends[a] : ends[b]]
            if held and held[:2] == (bucket, word):
                some = np.concatenate([held[2], some])
            elif held:
                cut(*held, out)
            some = np.unique(some)
            # ids of the last slot may still come, in any order; those before it are all here
            whole = np.searchsorted(some, (some[-1] >> SLOT_BITS) << SLOT_BITS) // BLOCK * BLOCK
            cut(bucket, word, some[:whole], out)
            held = (bucket, word, some[whole:])
        if out:
            yield batch_of(out)
    if held is not None:
        out = []
        cut(*held, out)
        if out:
            yield batch_of(out)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, id) of every posting."""
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("word", "first", "deltas"))
        for word, first, deltas in zip(*columns, strict=True):
            ids = unpack_ids(first, deltas)
            yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(len(ids), np.int32), pa.array([word])).cast(pa.string()), pa.array(ids)], names=["word", "id"])


class TextIndex:
    """An index at ``path`` in as many word ``buckets`` as it was first written with.

    ``add`` files one more segment; ids are whole numbers, and a row without an id cannot be found. Words are those of
    ``tokens``: a null or empty text has none. An id that is added twice counts once. Documents are added, not changed:
    a text that changed needs an id of its own, or an index built anew. A segment appears whole when its job commits.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, key: str, text: str) -> TextIndex:
        """Index the rows of ``docs``; returns the index."""
        words = docs.where(F.col(key).isNotNull()).select(F.explode(tokens(F.col(text))).alias("word"), F.col(key).cast("bigint").alias("id"))
        lists = words.where("id IS NOT NULL").mapInArrow(_lists, "word STRING, slot BIGINT, ids ARRAY<BIGINT>")
        # written once: the bounds of the ranges come from a sample, which would read the texts once more
        path = f"{shared_dir(self.spark)}/posting-lists-{uuid.uuid4().hex}"
        lists.select(self._bucket(F.col("word")).alias("bucket"), "word", "slot", "ids").write.parquet(path)
        posts = self.spark.read.schema("bucket INT, word STRING, slot BIGINT, ids ARRAY<BIGINT>").parquet(path)
        ranged = posts.repartitionByRange("bucket", "word", "slot").sortWithinPartitions("bucket", "word", "slot")
        blocks = ranged.mapInArrow(_blocks, BLOCKS).sortWithinPartitions("bucket", "word", "first")
        blocks.write.partitionBy("bucket").parquet(f"{self.path}/segment={uuid.uuid4().hex}")
        return self

    def _segments(self) -> list[str]:
        """Folders of the segments whose jobs have committed."""
        jvm, root = self.spark.sparkContext._jvm, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        folders = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("segment=")]
        return sorted(p.toString() for p in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def blocks(self, words: Sequence[str]) -> DataFrame:
        """The posting blocks of the words; only their buckets are listed and read."""
        wanted = sorted({w.lower() for w in words})
        parts = self._segments()
        if not parts or not wanted:
            return self.spark.createDataFrame([], BLOCKS)
        numbers = [r[0] for r in self.spark.createDataFrame([(w,) for w in wanted], "word string").select(self._bucket(F.col("word"))).collect()]
        found = None
        for p in parts:
            one = self.spark.read.schema(BLOCKS).option("basePath", p).parquet(p)
            found = one if found is None else found.unionByName(one)
        return found.where(F.col("bucket").isin(sorted(set(numbers))) & F.col("word").isin(wanted))

    def frequencies(self, words: Sequence[str]) -> DataFrame:
        """(word, n): ids of each word that has any, from the blocks' counts alone.

        An id that was added in several segments counts in each.
        """
        return self.blocks(words).groupBy("word").agg(F.sum("n").alias("n"))

    def search_any(self, words: Sequence[str], low: int | None = None, high: int | None = None) -> DataFrame:
        """(id) of the texts that have any of the words, between ``low`` and ``high`` where given, each once."""
        return self._postings(self.blocks(words), low, high).select("id").distinct()

    def search_all(self, words: Sequence[str], low: int | None = None, high: int | None = None) -> DataFrame:
        """(id) of the texts that have all of the words. Blocks outside the narrowest common bounds are not unpacked."""
        wanted = {w.lower() for w in words}
        blocks = self.blocks(words)
        bounds = blocks.groupBy("word").agg(F.min("first").alias("a"), F.max("last").alias("b"))
        a, b = bounds.agg(F.max("a")).scalar(), bounds.agg(F.min("b")).scalar()
        posts = self._postings(blocks.where((F.col("last") >= a) & (F.col("first") <= b)), low, high).distinct()
        return posts.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id")

    @staticmethod
    def _postings(blocks: DataFrame, low: int | None, high: int | None) -> DataFrame:
        if low is not None:
            blocks = blocks.where(F.col("last") >= low)
        if high is not None:
            blocks = blocks.where(F.col("first") <= high)
        posts = blocks.select("word", "first", "deltas").mapInArrow(_ids, "word STRING, id BIGINT")
        if low is not None:
            posts = posts.where(F.col("id") >= low)
        return posts if high is None else posts.where(F.col("id") <= high)

    def rows(self, docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
        """The rows of ``docs`` whose key is among the ids found."""
        return docs.join(found, docs[key] == found["id"], "left_semi")
