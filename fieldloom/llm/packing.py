"""Packing of token sequences by cutting-stock column generation.

A document's ids are cut at every ``capacity`` ids; its pieces have lengths 1 to ``capacity``. Lengths are counted in
a histogram, which is all that the driver gets: short pieces by their exact length, longer ones in bins that take at
most 1 / 18 more room than the piece needs (see ``bins``), on average about 1 / 60. A linear program over packing patterns is solved there by column generation: the simplex method keeps a
basis of patterns, first those of a greedy plan, then a knapsack dynamic program over the dual prices gives the next
pattern, until none pays. The solution's whole parts are used; what rounding leaves (fewer than one sequence for each pattern of the basis) is
packed greedily, largest bin first. Pieces are then ranked within their bin by a distributed count, and a rank's place
among the patterns' slots is its sequence.

The ranking splits every bin over about sqrt(pieces) salts, so that neither a salt's rows nor a bin's salts are many,
also where a third of all pieces have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import stored, text_of
from fieldloom.llm.wordpieces import blocks, encoder

CAPACITY, UNIT, END_ID = 2048, 8, 1
#: how far from the least number of sequences the linear program may stop
GAP = 2e-3
#: lengths up to ``EXACT`` units are counted exactly, beyond ``COARSE`` units in steps of two units
EXACT, COARSE = 4, 64
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def bins(capacity: int, unit: int) -> list[tuple[int, int]]:
    """(longest length, step) of each range of lengths: exact lengths first, then steps that double up to ``2 * unit``."""
    out, step = [], 1
    while step < unit:
        out.append((EXACT * unit * step, step))
        step *= 2
    out += [(COARSE * unit, step), (capacity, 2 * step if unit > 1 else 1)]
    below = sum(longest < capacity for longest, _ in out[:-1])
    return [*out[:below], (capacity, out[below][1])]


def room_of(length: Column, capacity: int, unit: int) -> Column:
    """The room that a piece of this length is counted with."""
    ranges = bins(capacity, unit)
    out = F.least(F.ceil(length / ranges[-1][1]) * ranges[-1][1], F.lit(capacity))
    for longest, step in reversed(ranges[:-1]):
        out = F.when(length <= longest, F.ceil(length / step) * step).otherwise(out)
    return out.cast("int")


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how often each size, together within ``room``. Sizes may repeat: 1, 2, 4, ... of a size
    are taken or left together, so any number can be had and each step is one operation over all rooms."""
    best, steps = np.zeros(room + 1), []
    for k, (size, value) in enumerate(zip(sizes.tolist(), values.tolist(), strict=True)):
        many = 1
        while value > 0 and many * size <= room:
            width = many * size
            got = best[: room + 1 - width] + many * value
            better = got > best[width:]
            np.maximum(best[width:], got, out=best[width:])
            steps.append((k, many, width, better))
            many *= 2
    pattern, c = np.zeros(len(sizes)), room
    for k, many, width, better in reversed(steps):
        if c >= width and better[c - width]:
            pattern[k] += many
            c -= width
    return float(best[room]), pattern


def largest_first(sizes: np.ndarray, demand: np.ndarray, room: int) -> Iterator[tuple[np.ndarray, int]]:
    """(pattern, number of sequences) that together hold ``demand``: each takes the largest sizes that are left and fit,
    and is used until one of its sizes runs out, so there are few of them whatever the demand."""
    left = demand.copy()
    while left.any():
        pattern, free = np.zeros(len(sizes), np.int64), room
        for i in np.flatnonzero(left)[::-1].tolist():
            pattern[i] = min(left[i], free // sizes[i])
            free -= int(pattern[i] * sizes[i])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= pattern * times
        yield pattern, times


def linear_program(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each, so that they hold ``demand`` in the fewest sequences.

    The optimum is at least the total size over the room, and the present number of sequences over the best pattern's
    value; columns are added until the present number exceeds one of them by the share ``gap`` at most. The first columns
    are the patterns of a greedy plan, from which few are missing; they cost no pricing.
    """
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ demand
    pool = np.array([pattern for pattern, _ in largest_first(sizes, demand, room)], float)
    offers = 4 * len(pool)  # only so that rounding can't offer the same ones for ever
    while True:
        prices = inverse.sum(axis=0)
        worth = pool @ prices
        if offers and worth.max() > 1 + max(gap / 2, 1e-6):
            offers -= 1
            pattern = pool[worth.argmax()]
        else:
            value, pattern = price(prices, sizes, room)
            if use.sum() <= (1 + gap) * max(use.sum() / value, sizes @ demand / room):
                break
        way = inverse @ pattern
        ratio = np.where(way > 1e-9, use / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * way, 0)
        use[out] = ratio[out]
        basis[:, out] = pattern
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    return basis, np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)


def patterns_for(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern: size -> how often, number of sequences) that together hold every piece of ``histogram``."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes])
    columns, use = linear_program(sizes, demand, room)
    whole = np.floor(use + 1e-9).astype(np.int64)
    left, plan = demand.copy(), []
    named = lambda column: {int(s): int(c) for s, c in zip(sizes, column, strict=True) if c}
    for k in np.argsort(-whole, kind="stable"):
        column = columns[:, k].round().astype(np.int64)
        times = int(min(whole[k], *(left[column > 0] // column[column > 0])))
        if times > 0:
            plan.append((named(column), times))
            left -= column * times
    return plan + [(named(pattern), times) for pattern, times in largest_first(sizes, left, room)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text), ids as little-endian unsigned numbers (16-bit where the vocabulary allows).

    A null text is empty: its one piece holds ``end_id`` alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        width = np.dtype("<u2") if len(words.ends) <= 1 << 16 else np.dtype("<u4")
        for batch in batches:
            for block in blocks(batch, "text"):
                ids, counts = words.block(block.column("text"))
                totals = counts + 1
                ends = np.cumsum(totals)
                flat = np.full(int(ends[-1]), end_id, width)
                inner = np.ones(len(flat), bool)
                inner[ends - 1] = False
                flat[inner] = ids
                n = -(-totals // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, totals[doc] - start)
                offsets = np.concatenate([[0], np.cumsum(length)]) * width.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(totals[doc]), data], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(cut, PIECES)


def placed(lengths: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """piece_id, sequence_id, offset for every row of ``lengths`` (piece_id: unique, length: 1 to ``capacity``)."""
    spark = lengths.sparkSession
    sized = lengths.select("piece_id", "length", room_of(F.col("length"), capacity, unit).alias("size"))
    histogram = {r.size: r.n for r in sized.groupBy("size").agg(F.count("*").alias("n")).select("size", "n").collect()}
    plan = patterns_for(histogram, capacity)

    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, first = dict.fromkeys(histogram, 0), 0
    for pattern, times in plan:
        for size, many in pattern.items():
            slots.setdefault(size, []).append((taken[size], taken[size] + many * times, many, first))
            taken[size] += many * times
        first += times
    # a row for each bin; rows and slots are bounded by the bins, whatever the input
    table = spark.createDataFrame(list(slots.items()), "size int, slots array<struct<low:long,high:long,many:long,first:long>>")

    salts = isqrt(sum(histogram.values())) + 1
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("piece_id"), F.lit(salts)))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("size", "salt").agg(F.count("*").alias("n")).select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = salted.withColumn("place", F.row_number().over(Window.partitionBy("size", "salt").orderBy("piece_id")))
    ranked = own.join(offsets, ["size", "salt"]).withColumn("rank", F.col("ahead") + F.col("place") - 1)
    slot = F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    dealt = ranked.join(F.broadcast(table), "size").withColumn("slot", slot)
    dealt = dealt.select("piece_id", "length", "size", (F.col("slot.first") + F.expr("(rank - slot.low) div slot.many")).alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "piece_id").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select("piece_id", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """Sequences of at most ``capacity`` ids that hold every row of ``docs`` (doc_id, text).

    Returns a row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned
    32-bit). The pieces of a sequence fill it from 0 without gaps; what is left up to ``capacity`` is padding, which
    is not stored. A null text is empty; repeated rows are packed as often as they stand there; other columns are not
    carried; an empty table gives no row.
    """
    cut = pieces(docs, tokenizer, capacity, end_id)
    cut = stored(cut.withColumn("piece_id", F.monotonically_increasing_id()), "pieces")
    seats = placed(cut.select("piece_id", "length"), capacity, unit)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                lengths = np.asarray(part.column("length"), np.int64)
                raw = part.column("ids").cast(pa.large_binary())
                offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                size = int((offsets[-1] - offsets[0]) // max(1, lengths.sum()))
                ids = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(f"<u{size}").astype("<u4") if len(raw) else np.zeros(0, "<u4")
                ends = np.concatenate([[0], np.cumsum(lengths)]) * 4
                wide = pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield part.set_column(part.schema.get_field_index("ids"), "ids", wide)

    joined = cut.join(seats.hint("shuffle_hash"), "piece_id").select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    return joined.mapInArrow(widen, joined.schema)
