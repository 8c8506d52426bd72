"""WARC archives in Zstandard frames, each archive with a dictionary built from its own records.

An archive is a file of frames: a skippable frame that holds the dictionary, then one frame a record, so that any
record can be read alone once the dictionary is known. Spark deals the records out; a task writes the records of its
partition as one archive. It holds the first ``SAMPLE_BYTES`` of records, trains the dictionary on them, and streams
the rest, so its memory does not depend on the partition.

An archive's file name is new in every attempt of a task, and only the names in the committed index table count: a
task that is lost and repeated, or that runs twice, leaves at most a file that nothing names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import scratch, stored, text_of

SAMPLE_BYTES = 2 << 20
DICT_BYTES = 64 << 10
MIN_REVISIT_BYTES = 1000
#: fixed value of the archive format: the skippable frame that holds a dictionary
DICT_FRAME = (0x184D2A5D).to_bytes(4, "little")
DATE = "1970-01-01T00:00:00Z"

INDEX = "archive string, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _uri(url: str | None, page_id: int | None) -> str:
    """The target URI, with what would break a header line in percent form."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _labelled(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, refers_url, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response that holds it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest + '/revisit' * revisit)}",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {_labelled(digest)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"WARC-Refers-To-Target-URI: {_uri(refers_url, refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of samples too few or too small to train on, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def frames(records: Iterable[bytes], sample_bytes: int = SAMPLE_BYTES, level: int = 3) -> Iterator[bytes]:
    """The archive's frames: the dictionary's, then one a record. No records: no frames."""
    held, size, records = [], 0, iter(records)
    for r in records:
        held.append(r)
        size += len(r)
        if size >= sample_bytes:
            break
    if not held:
        return
    # a huge record counts by its beginning in training only; it is archived whole
    trained = dictionary_of([r[: 128 << 10] for r in held])
    yield DICT_FRAME + len(trained).to_bytes(4, "little") + trained
    writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    for r in held:
        yield writer.compress(r)
    held.clear()
    for r in records:
        yield writer.compress(r)


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, read as a stream."""
    head = stream.read(8)
    if len(head) < 8:
        return
    if head[:4] != DICT_FRAME:
        raise ValueError("an archive begins with its dictionary")
    trained = stream.read(int.from_bytes(head[4:], "little"))
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    plain = io.BufferedReader(reader.stream_reader(stream, read_across_frames=True), 1 << 16)
    while line := plain.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("a record begins with its version")
        headers = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            headers[key] = value.strip()
        block = plain.read(int(headers["Content-Length"]))
        plain.read(4)
        yield headers, block


def with_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest and, for revisits, the response that they name.

    Of records with equal payloads of ``min_bytes`` or more, the one with the largest page_id is the response and the
    others revisit it. Rows that repeat that page_id with the same payload are responses too; null ids come last.
    """
    records = pages.select("page_id", "url", text_of("html").cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    originals = (
        records.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "first.page_id", "first.url")
        .toDF("digest", "refers_to", "refers_url")
    )
    joined = records.join(originals, "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id")) & (F.octet_length("payload") >= min_bytes)
    return joined.select("page_id", "url", "payload", "digest", "refers_to", "refers_url", revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, sample_bytes: int = SAMPLE_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html) below ``folder``; returns the index: archive, records.

    A null html is an empty payload, a null url a URN of the page. Other columns are not archived. An empty table
    gives no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0

        def records():
            nonlocal count
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    for row in batch.slice(start, 64).to_pylist():
                        count += 1
                        yield record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["refers_url"], row["revisit"])

        out, store, path = None, None, ""
        for frame in frames(records(), sample_bytes):
            if out is None:
                store, base = arrow_fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.zst"
                path, out = f"{folder}/{name}", store.open_output_stream(f"{base}/{name}")
            out.write(frame)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["archive", "records"])

    return stored(with_originals(pages, min_bytes).mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the archives that ``index`` names; a revisit has no payload of its own."""

    def rows(path: str) -> Iterator[dict]:
        store, base = arrow_fs.FileSystem.from_uri(path)
        with store.open_input_stream(base, buffer_size=1 << 20) as stream:
            for headers, block in records_of(stream):
                http, _, payload = block.partition(b"\r\n\r\n")
                revisit = headers["WARC-Type"] == "revisit"
                page, other = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                yield {
                    "page_id": None if page is None else int(page),
                    "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]) if revisit else len(payload),
                    "payload_digest": base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest(),
                    "record_type": headers["WARC-Type"],
                    "refers_to": None if other is None else int(other),
                    "payload": None if revisit else payload,
                }

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    archives = max(1, index.count())
    return index.select("archive").repartition(archives, "archive").mapInArrow(read, RECORDS)


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives in the shared folder."""
    return scratch(pages.sparkSession, "warc")
