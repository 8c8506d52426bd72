"""Tokens of two tokenizers over the same bytes, grouped where both end, and how often their ids meet.

Tokenizer A is a byte-level BPE file read with a space before the text; tokenizer B is a SentencePiece model, which adds
that space itself. Each token points to the token of the other side that reaches farthest right of those it overlaps; a
token of B that ends where a token of A ends points to itself. Doubling these pointers until they stay leads every token
to the last one of its group, which names the group.

What a text gives is the sum of what its chunks give (``chunks``), so the distinct chunks of a part are aligned once,
all in the same arrays. A task gathers its texts into blocks. A block has a row for each different pair of ids in it,
with the number of its documents that hold the pair; Spark sums these over all blocks and sends every block the counts
of its own pairs, where the documents wait with their pairs by place in the block's list. So no document's pair is ever
a row, and no table of all pairs is in one place.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.bpe_trie import TrieEncoder
from fieldloom.llm.chunks import chunks
from fieldloom.llm.common import bounded_batches, stored, text_of
from fieldloom.llm.shingles import bytes_of
from fieldloom.llm.wordpieces import blocks, gathered

#: bytes of text that are aligned at once, bytes of a block, and aligned chunks that a worker remembers
PART, BLOCK, REMEMBERED = 2 << 20, 16 << 20, 200_000
MARK = "▁"
DIGITS = 1 << 32


def grouped(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of A and of B, by the ends of the tokens, which go from 0 to the same last byte.

    Groups are numbered from left to right.
    """
    na, nb = len(a_ends), len(b_ends)
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    to_b = np.searchsorted(b_starts, a_ends, "left") - 1
    to_a = np.searchsorted(a_starts, b_ends, "left") - 1
    last = a_ends[to_a] == b_ends if na else np.zeros(nb, bool)
    succ = np.concatenate([na + to_b, np.where(last, na + np.arange(nb), to_a)])
    while True:  # each round doubles the way; the longest chain of overlaps decides how many there are
        farther = succ[succ]
        if np.array_equal(farther, succ):
            break
        succ = farther
    number = np.cumsum(last) - 1
    return number[succ[:na] - na], number[succ[na:] - na]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in A, place in B) of tokens that share a byte, by A then B."""
    a_starts = np.concatenate([[0], a_ends[:-1]])
    first = np.searchsorted(b_ends, a_starts, "right")
    n = np.searchsorted(b_ends, a_ends, "left") - first + 1
    left = np.repeat(np.arange(len(a_ends)), n)
    return left, np.arange(len(left)) + np.repeat(first - (np.cumsum(n) - n), n)


def pooled(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of ``values``, where each begins, how long each is."""
    sizes = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes, sizes


def same_bytes(left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """Whether two lists of byte strings, each list in one array, hold the same string at each place."""
    same = left_sizes == right_sizes
    at = np.repeat(np.flatnonzero(same), left_sizes[same])
    same[at[left[np.repeat(same, left_sizes)] != right[np.repeat(same, right_sizes)]]] = False
    return same


class Aligner:
    """Chunks by both tokenizers, aligned; what was aligned is remembered for a while."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = TrieEncoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        pieces = self.b.id_to_piece(list(range(n)))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path_b} has pieces that go on after a space mark, so texts can't be cut there")
        #: what cannot stand in a text, as the unknown token, is the replacement character: it never equals the text's bytes
        b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else b"\xff" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b_pool, self.b_starts, self.b_sizes = pooled(b_bytes)
        self.a_sizes = np.zeros(max(self.a.bytes) + 1, np.int64)
        self.a_sizes[list(self.a.bytes)] = [len(x) for x in self.a.bytes.values()]
        #: each id in digits, with what comes after it
        self.digits, self.digit_starts, self.digit_sizes = pooled([b"%d," % i for i in range(max(n, len(self.a_sizes)))])
        space = self.b.piece_to_id(MARK)
        self.space = [space] if pieces[space] == MARK else None
        self.forget()

    def forget(self) -> None:
        #: by row: n_a, n_b, n_groups, 1 where B does not give the chunk's bytes; and the groups' text
        self.rows: dict[str, int] = {}
        self.told = np.zeros((0, 4), np.int64)
        self.groups: list[str] = []
        self.links, self.link_from, self.link_count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, names: list[str]) -> list[list[int]]:
        """B's ids of chunks, each of which begins with the space that the model adds."""
        out = self.b.encode([c[1:] for c in names], num_threads=1)
        return [self.space if c == " " and self.space else p for c, p in zip(names, out, strict=True)]

    def _learn(self, names: list[str]) -> None:
        self.a.make_room()
        a_ids, a_edges = self.a.ids_of(names)
        pieces = self._pieces(names)
        told = np.zeros((len(names), 4), np.int64)
        told[:, 0] = np.diff(a_edges)
        told[:, 1] = np.fromiter(map(len, pieces), np.int64, len(names))
        b_edges = np.concatenate([[0], np.cumsum(told[:, 1])])
        b_ids = np.fromiter(chain.from_iterable(pieces), np.int64, int(b_edges[-1]))
        given, ends, _ = gathered(self.b_pool, self.b_starts, self.b_sizes, b_ids)
        asked, bounds = bytes_of(pa.array(names, pa.string()))
        good = same_bytes(given, np.diff(np.concatenate([[0], ends])[b_edges]), asked, np.diff(bounds))
        told[:, 3] = ~good
        b_ids = b_ids[np.repeat(good, told[:, 1])]
        a_ids = a_ids[np.repeat(good, told[:, 0])].astype(np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        a_group, b_group = grouped(a_ends, b_ends)
        left, right = overlaps(a_ends, b_ends)
        # groups never go over the end of a chunk, where a token of each side ends
        owner = np.flatnonzero(good)
        a_owner, b_owner = np.repeat(owner, told[good, 0]), np.repeat(owner, told[good, 1])
        total = int(b_group[-1]) + 1 if len(b_group) else 0
        group_owner = np.zeros(total, np.int64)
        group_owner[b_group] = b_owner
        told[:, 2] = np.bincount(group_owner, minlength=len(names))
        counts = np.bincount(a_owner[left], minlength=len(names))
        self.link_from = np.concatenate([self.link_from, np.cumsum(counts) - counts + len(self.links)])
        self.link_count = np.concatenate([self.link_count, counts])
        self.links = np.concatenate([self.links, a_ids[left] * DIGITS + b_ids[right]])
        # the groups' text: ids of A and B in turn, group by group, in digits; then what ends a side and a group
        a_place = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, "left")
        b_place = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, "right")
        ids = np.zeros(len(a_ids) + len(b_ids), np.int64)
        ids[a_place], ids[b_place] = a_ids, b_ids
        text, ends, _ = gathered(self.digits, self.digit_starts, self.digit_sizes, ids)
        for mark, place, group in ((b"|", a_place, a_group), (b";", b_place, b_group)):
            text[ends[place[np.append(group[1:] != group[:-1], True)[: len(group)]]] - 1] = mark[0]
        text = text.tobytes().decode()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.where(good, told[:, 0] + told[:, 1], 0))])].tolist()
        self.groups += [text[p : max(p, q - 1)] for p, q in zip(edges, edges[1:], strict=False)]
        self.rows.update(zip(names, range(len(self.told), len(self.told) + len(names)), strict=True))
        self.told = np.concatenate([self.told, told])

    def rows_of(self, names: list[str]) -> np.ndarray:
        """The remembered row of each of ``names``, which are distinct chunks."""
        if len(self.rows) > REMEMBERED:
            self.forget()
        rows = list(map(self.rows.get, names))
        if None in rows:
            self._learn([c for c, r in zip(names, rows, strict=True) if r is None])
            rows = list(map(self.rows.get, names))
        return np.array(rows, np.int64)


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner. It is kept on the tokenizers module, which lives as long as the worker."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_aligners", {})
    if (path_a, path_b) not in held:
        held[path_a, path_b] = Aligner(path_a, path_b)
    return held[path_a, path_b]


class _Block:
    """Documents with the pairs of ids that each holds, until the block is written."""

    def __init__(self):
        self.size, self.docs, self.keys, self.times, self.counts = 0, [], [], [], []

    def add(self, who: Aligner, part: pa.RecordBatch) -> None:
        texts = part.column("text")
        names, places, bounds = chunks(texts, led=True)
        row = who.rows_of(names) if names else np.zeros(0, np.int64)
        at = row[places]
        n = part.num_rows
        doc = np.repeat(np.arange(n), np.diff(bounds))
        sums = np.zeros((n, 4), np.int64)
        for k in range(4):
            sums[:, k] = np.bincount(doc, who.told[at, k], n)
        empty = np.asarray(pa.compute.equal(texts, ""))
        sums[(sums[:, 3] > 0) | empty] = 0
        live = sums[:, 0] > 0
        # the pairs of a document, each with the number of times it is there
        kept = live[doc]
        chunk_rows = at[kept]
        links, _, lens = gathered(who.links, who.link_from, who.link_count, chunk_rows)
        distinct, key = np.unique(links, return_inverse=True)
        pair, times = np.unique(np.repeat(doc[kept], lens) * (len(distinct) + 1) + key, return_counts=True)
        owner, key = np.divmod(pair, len(distinct) + 1)
        self.keys.append(distinct[key])
        self.times.append(times)
        self.counts.append(np.bincount(owner, minlength=n))
        groups = who.groups
        at, bounds = at.tolist(), bounds.tolist()
        for k, (doc_id, ok) in enumerate(zip(part.column("doc_id").to_pylist(), live.tolist(), strict=True)):
            digest = hashlib.sha256(";".join([groups[r] for r in at[bounds[k] : bounds[k + 1]]]).encode()).hexdigest() if ok else ""
            self.docs.append((doc_id, *sums[k, :3].tolist(), digest))
        self.size += texts.nbytes

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows of the block's pairs, then of its documents."""
        name = uuid.uuid4().int >> 65
        keys, times, counts = np.concatenate(self.keys), np.concatenate(self.times), np.concatenate(self.counts)
        pairs, place, held = np.unique(keys, return_inverse=True, return_counts=True)
        n = len(pairs)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(np.arange(n, dtype=np.int64)), pa.array(pairs), pa.array(held.astype(np.int64)), none, none, none, none, pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], schema=BLOCK_ROWS)
        pack = zstandard.ZstdCompressor(level=1).compress
        ends = np.cumsum(counts).tolist()
        where = []
        for a, b in zip([0, *ends], ends, strict=False):
            numbers = np.concatenate([np.diff(place[a:b], prepend=0), times[a:b]]).astype("<u4")
            where.append(pack(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T)) if b > a else b"")
        n = len(self.docs)
        none = pa.nulls(n, pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*self.docs, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), none, none, none, *columns, pa.array(where, pa.binary())], schema=BLOCK_ROWS)


BLOCK_ROWS = pa.schema([(c, pa.int64()) for c in ("block", "place", "pair", "held", "doc_id", "n_a", "n_b", "n_groups")] + [("groups_sha256", pa.string()), ("links", pa.binary())])
ROWS = "block long, place long, pair long, held long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
RESULT = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    who, block = aligner(path_a, path_b), _Block()
    for batch in batches:
        for part in blocks(batch, "text", PART):
            block.add(who, part)
            if block.size >= BLOCK:
                yield from block.rows()
                block = _Block()
    if block.docs:
        yield from block.rows()


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with sums over their links; rows come by block, its pairs in order of place before its documents."""
    unpack = zstandard.ZstdDecompressor().decompress
    block, count, best, fresh = None, [], [], False
    for batch in batches:
        names = np.asarray(batch.column("block"))
        edges = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b == a:
                continue
            if names[a] != block:
                block, count, best, fresh = names[a], [], [], False
            part = batch.slice(a, b - a)
            pairs = part.filter(part.column("place").is_valid())
            if pairs.num_rows:
                count.append(np.asarray(pairs.column("total"), np.int64))
                best.append(np.asarray(pairs.column("best"), np.int64))
                fresh = True
            docs = part.filter(part.column("place").is_null())
            if not docs.num_rows:
                continue
            if fresh:
                count, best, fresh = [np.concatenate(count)], [np.concatenate(best)], False
            out = []
            for packed in docs.column("links").to_pylist():
                if not packed:
                    out.append((0, 0, 0))
                    continue
                numbers = np.ascontiguousarray(np.frombuffer(unpack(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
                place, times = np.cumsum(numbers[: len(numbers) // 2]), numbers[len(numbers) // 2 :]
                out.append((int(times.sum()), int((times * best[0][place]).sum()), int((times * count[0][place]).sum())))
            sums = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *sums, docs.column("groups_sha256")], schema=RESULT)


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_links counts the pairs of an A and a B token that share a byte. The count of a pair of ids is the number of rows of
    ``docs`` that hold it linked; count_sum adds the counts of a text's links, n_best counts the links whose count is the
    highest of their A id in the whole corpus, ties included. groups_sha256 digests the groups, as in ``a1,a2|b1;a3|b2``.
    The texts of special tokens are plain text. Texts that are null or empty, or that the ids of one side don't give back,
    have no tokens: zeros and an empty digest. Rows that repeat an id or a text are rows like all others, and null ids
    stay. Other columns are not carried, so their names don't matter. An empty table gives no rows. A text is held whole
    by one task; it may be longer than a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _aligned(batches, path_a, path_b)

    rows = bounded_batches(docs, 4 << 20).select("doc_id", text_of(text).alias("text"))
    parts = stored(rows.mapInArrow(run, ROWS), "aligned")
    pairs = parts.where("place IS NOT NULL").select("block", "place", "pair", "held")
    totals = pairs.groupBy("pair").agg(F.sum("held").alias("total"))
    totals = stored(totals, "pair_counts")
    left = F.shiftright("pair", 32)
    # a row an id of A: no more than its vocabulary has
    highest = totals.groupBy(left.alias("left")).agg(F.max("total").alias("highest"))
    marked = totals.join(F.broadcast(highest), left == F.col("left")).select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    known = pairs.select("block", "place", "pair").join(marked, "pair").select("block", "place", "total", "best")
    waiting = parts.where("place IS NULL").drop("place", "pair", "held")
    every = known.unionByName(waiting, allowMissingColumns=True)
    # nulls last: a block's pairs come before its documents
    ordered = every.repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_last())
    return ordered.mapInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
