"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, which every executor can reach."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: Column | str) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind each as it takes to be no column of ``df``, upper and lower case alike."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def bounded_batches(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """``df`` as it is, with a session whose Arrow batches stop at ``max_bytes``, so that long texts do not add up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))
    return df


def labelled_ids(docs: DataFrame, told: DataFrame, label: str, most: dict[int, int]) -> list[Row]:
    """Ids of ``docs`` with their label of ``told`` (doc_id, label), at most ``most[label]`` of each, in the order of a hash."""
    there = docs.select("doc_id").join(told, "doc_id").distinct()
    parts = [there.where(F.col(label) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in most.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    return chosen.collect()


def labelled_sample(docs: DataFrame, told: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """The rows of ``docs`` with a label of ``told`` (doc_id, label), at most ``most[label]`` of each label.

    Ids are chosen first, in the order of a hash; they are few whatever the input, so they are sent to the documents
    and no text is shuffled. Of rows that repeat an id, all are taken.
    """
    rows = labelled_ids(docs, told, label, most)
    return docs.join(F.broadcast(docs.sparkSession.createDataFrame(rows, told.select("doc_id", label).schema)), "doc_id")


#: bits of a sieve; the sieve of any number of keys is this large at most
SIEVE_BITS = 1 << 24


def sifted(rows: DataFrame, key: Column, keys: DataFrame, other: Column, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: true wherever ``key`` is among ``keys``' values of ``other``, and in few other rows.

    The keys set bits by their hash; the bits are at most ``SIEVE_BITS``, whatever the number of keys, and so may be
    broadcast.
    """
    bit = F.pmod(F.xxhash64(other), F.lit(SIEVE_BITS)) + 1
    bits = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("sieve_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("sieve_bits"))
    place = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)) + 1
    marked = rows.withColumn("sieve_bucket", F.bitmap_bucket_number(place)).withColumn("sieve_place", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.substring("sieve_bits", (F.col("sieve_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(sieve_byte, cast(sieve_place % 8 as int))").bitwiseAND(F.lit(1)) == 1
    found = marked.join(F.broadcast(bits), "sieve_bucket", "left").withColumn("sieve_byte", byte).withColumn(name, F.coalesce(hit, F.lit(False)))
    return found.drop("sieve_bucket", "sieve_place", "sieve_bits", "sieve_byte")


def sieved(rows: DataFrame, key: Column, keys: DataFrame, other: Column) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``keys``' values of ``other``, to shuffle fewer of them.

    Every row whose key is there passes.
    """
    return sifted(rows, key, keys, other, "sieve_hit").where("sieve_hit").drop("sieve_hit")
