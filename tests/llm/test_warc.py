from __future__ import annotations

import hashlib
import io
import random

import zstandard

from fieldloom.llm.warc import DICT_FRAME, frames, read_archives, record_bytes, records_of, with_originals, write_archives
from fieldloom.session import shared_dir

SCHEMA = "page_id long, url string, html string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)


def test_frames_are_single_records_behind_a_dictionary():
    rng = random.Random(1)
    records = [record_bytes(k, f"http://a/{k}", b"<p>" + bytes(rng.choices(b"abcdef ", k=400)), "00" * 20, None, None, False) for k in range(300)] + [b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]
    parts = list(frames(iter(records), sample_bytes=20_000))
    assert parts[0][:4] == DICT_FRAME and len(parts) == len(records) + 1
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(parts[0][8:]))
    assert [reader.decompress(p) for p in parts[1:]] == records
    assert len(list(records_of(io.BytesIO(b"".join(parts))))) == len(records)
    assert list(frames(iter([]))) == [] and list(records_of(io.BytesIO(b""))) == []
    assert len(list(frames(iter([b"one"])))) == 2  # too little to train on


def test_round_trip(spark):
    big, other = "é" * 600, "y" * 1000
    rows = [(1, "http://a/ \r\nX: y", big), (2, None, big), (3, "u", big), (3, "u", big), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", other), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]
    rows += [(k, "u", f"<p>{k}</p>" * 50_000) for k in (20, 21)]
    index = write_archives(table(spark, rows), f"{shared_dir(spark)}/warc-test", sample_bytes=2000)
    assert sum(r.records for r in index.collect()) == len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in read_archives(index).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max((j for j, _, h in rows if h == html and j is not None), default=None)
        revisit = len(data) >= 1000 and top != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None, None if revisit else data))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=repr)]
    assert [bytes(g[5]) if g[5] is not None else None for g in got] == [w[5] for w in sorted(want, key=repr)]


def test_empty(spark):
    index = write_archives(table(spark, []), f"{shared_dir(spark)}/warc-empty")
    assert index.collect() == [] and read_archives(index).collect() == []
    assert with_originals(table(spark, [])).collect() == []
