"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

Text is cut before every run of spaces and nowhere else, so a segment is as long as the text has it; pieces do not cross
these cuts. All segmentations of such a segment are a lattice of the vocabulary's pieces, characters without a piece going
through byte pieces. Forward filtering adds up the weights of all ways to each place of each distinct segment; backward
sampling then draws, for each segment of each text, the last piece in proportion to the ways through it, and so on to the
front. That is an exact sample of the whole segmentation.

Segments of up to ``WIDE`` characters are walked together, place by place. A longer one is walked alone through windows
that overlap by the longest piece: the forward sums of all its places are kept, the lattice only of the window at hand.

The random number of a draw is a hash of the row's key, the segment's place in its text and the step, so a text gets the
same pieces wherever and whenever it is encoded. Decoding gives back every text exactly: spaces are the vocabulary's
space mark, and a mark that stands in a text itself goes through bytes.

A unigram model's scores are log probabilities; a merge model's are ranks, which are taken as a Zipf law.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded_batches, text_of
from fieldloom.llm.shingles import STEP, mixed
from fieldloom.llm.wordpieces import blocks

MARK, LITERAL_MARK = 0x2581, 0x110000
#: characters of a segment from which on it is walked alone, and of its windows; neither changes what is drawn from
WIDE, WINDOW = 256, 1 << 14
#: a byte costs this much more than the rarest piece
BYTE_COST = 2.0
#: upper bits of a hash by which pieces are looked up; it changes no result
BUCKET_BITS = 20
#: characters of text in a block, and bytes of a batch; both only bound memory
CHARS, BATCH = 1 << 20, 4 << 20


def _place_weights(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def _symbols(cps: np.ndarray) -> np.ndarray:
    return mixed(cps.astype(np.uint64) + np.uint64(0x51ED27))


def _uniform(seeds: np.ndarray, steps: np.ndarray | int) -> np.ndarray:
    """Numbers between 0 and 1 for a draw's seed and step."""
    step = np.atleast_1d(np.asarray(steps, np.uint64)) + np.uint64(1)
    return (mixed(seeds + step * STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _by_stop(stop: np.ndarray, places: int) -> np.ndarray:
    """The stable order of ``stop``: runs that rise, one for each length of a piece, so that a run has a place at most once."""
    behind = np.cumsum(np.bincount(stop, minlength=places)) - np.bincount(stop, minlength=places)
    order = np.empty(len(stop), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(stop) <= 0) + 1).tolist(), len(stop)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = behind[stop[a:b]]
        order[at] = np.arange(a, b)
        behind[stop[a:b]] = at + 1
    return order


class Lattice:
    """The pieces of a model file, ready to be looked up by hash."""

    def __init__(self, path: str, temperature: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = np.array([sp.get_score(i) for i in plain])
        ranked = bool((scores == np.round(scores)).all())
        weight = -np.log(1.0 + np.maximum(0, -scores)) if ranked else scores
        weight = weight / temperature
        self.weight = np.full(len(ids), -np.inf)
        self.weight[plain] = weight - np.log(np.exp(weight - weight.max()).sum()) - weight.max()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.byte_weight = float(self.weight[plain].min()) - BYTE_COST
        pieces = {i: np.frombuffer(sp.id_to_piece(i).encode("utf-32-le"), "<u4") for i in plain}
        self.longest = max(map(len, pieces.values()))
        self.places = _place_weights(self.longest)
        known: dict[int, int] = {}
        for i, cps in pieces.items():
            at = np.cumsum(_symbols(cps) * self.places[: len(cps)], dtype=np.uint64).tolist()
            for h in at[:-1]:
                known.setdefault(h, -1)
            known[at[-1]] = i
        keys = np.array(sorted(known), np.uint64)
        # behind the last key stands one that ends every search
        self.keys, self.ids = np.append(keys, np.uint64(2**64 - 1)), np.array([*(known[k] for k in keys.tolist()), known.get(2**64 - 1, -1)])
        self.first = np.searchsorted(keys, np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        raw = [bytes([self.byte_ids.tolist().index(i)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() if i in pieces else b"" for i in ids]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.array([len(r) for r in raw])
        self.raw_ends = np.cumsum(self.raw_sizes)

    def _looked_up(self, hashes: np.ndarray) -> np.ndarray:
        """The place of the first key that is not below each hash: few keys share a bucket, so a step or two find it."""
        at = self.first[(hashes >> np.uint64(64 - BUCKET_BITS)).view(np.int64)]
        below = np.flatnonzero(self.keys[at] < hashes)
        while len(below):
            at[below] += 1
            below = below[self.keys[at[below]] < hashes[below]]
        return at

    def edges(self, cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, stop, piece (-1: bytes), weight of all pieces that fit into ``cps``; ``ends``: end of each place's segment."""
        n = len(cps)
        symbols, active = _symbols(cps), np.flatnonzero(np.arange(n) < ends)
        hashes, found = np.zeros(len(active), np.uint64), []
        single = np.arange(n) >= ends  # the places behind segments are no characters
        for k in range(self.longest):
            inside = np.flatnonzero(active + k < ends[active])
            active, hashes = active[inside], hashes[inside]
            if not len(active):
                break
            hashes = hashes + symbols[active + k] * self.places[k]
            at = self._looked_up(hashes)
            hit = np.flatnonzero(self.keys[at] == hashes)
            active, hashes = active[hit], hashes[hit]
            piece = self.ids[at[hit]]
            whole = np.flatnonzero(piece >= 0)
            begin = active[whole]
            found.append((begin, begin + k + 1, piece[whole]))
            if k == 0:
                single[begin] = True
        rest = np.flatnonzero(~single)
        start, stop, piece = (np.concatenate(c) for c in zip(*found, (rest, rest + 1, np.full(len(rest), -1)), strict=True))
        used = cps[rest]
        width = 1 + (used > 0x7F).astype(int) + (used > 0x7FF) + ((used > 0xFFFF) & (used != LITERAL_MARK))
        weight = np.concatenate([self.weight[piece[: len(piece) - len(rest)]], width * self.byte_weight])
        return start, stop, piece, weight

    def block(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of ``texts`` (no nulls), and the number of ids of each; ``keys``: the rows' 64-bit keys."""
        lengths = np.asarray(pc.utf8_length(texts), np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        cps = np.frombuffer("".join(texts.to_numpy(zero_copy_only=False)).encode("utf-32-le"), "<u4").copy()
        if not len(cps):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        cps[cps == MARK] = LITERAL_MARK
        space = cps == 0x20
        cps[space] = MARK
        starts = np.zeros(len(cps), bool)
        starts[bounds[:-1][lengths > 0]] = True
        starts[1:] |= space[1:] & ~space[:-1]
        at = np.flatnonzero(starts)
        size = np.diff(np.append(at, len(cps)))
        doc = np.searchsorted(bounds, at, "right") - 1
        seed = mixed(keys[doc] + (at - bounds[doc]).astype(np.uint64) * STEP)
        wide = size > WIDE
        drawn = []
        for k in np.flatnonzero(wide).tolist():
            pieces, letters = self._alone(cps[at[k] : at[k] + size[k]], seed[k : k + 1])
            drawn.append((np.full(len(pieces), k), np.arange(len(pieces)), pieces, letters))
        if not wide.all():
            short = np.flatnonzero(~wide)
            segment, *found = self._together(cps[np.repeat(~wide, size)] if wide.any() else cps, size[short], seed[short])
            drawn.append((short[segment], *found))
        segment, steps, pieces, letters = (np.concatenate(c) for c in zip(*drawn, strict=True))
        many = np.bincount(segment, minlength=len(at))
        behind = np.cumsum(many)
        ids, letter = np.empty(len(segment), np.int64), np.empty(len(segment), np.uint32)
        to = behind[segment] - 1 - steps
        ids[to], letter[to] = pieces, letters
        per_text = np.diff(np.concatenate([[0], np.cumsum(np.bincount(doc, many, len(texts)))])).round().astype(np.int64)
        return self._with_bytes(ids, letter, per_text)

    def _together(self, cps: np.ndarray, size: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """segment, step (from its end), piece, first character of all draws; ``cps``: segments of these sizes, one after the other."""
        at = np.cumsum(size) - size
        inner = np.arange(len(cps)) - np.repeat(at, size)
        names = np.add.reduceat(_symbols(cps) * _place_weights(WIDE)[inner], at)
        coded = pa.array(names).dictionary_encode()
        kind = np.asarray(coded.indices)
        first = np.empty(len(coded.dictionary), np.int64)
        first[kind[::-1]] = np.arange(len(kind))[::-1]
        # the distinct segments, one after the other, with a place before each character and one behind the last
        own = size[first]
        head = np.cumsum(own + 1) - own - 1
        place = np.repeat(head - (np.cumsum(own) - own), own) + np.arange(own.sum())
        letters = cps[np.repeat(at[first] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
        same = letters[np.repeat((np.cumsum(own) - own)[kind], size) + inner]
        if not (same == cps).all():
            raise ValueError("two different segments have one hash")
        total = int((own + 1).sum())
        padded, ends = np.zeros(total, np.uint32), np.zeros(total, np.int64)
        padded[place] = letters
        ends[place] = np.repeat(head + own, own)
        start, stop, piece, weight = self.edges(padded, ends)

        # forward: by place in the segment, all segments at once
        order = _by_stop(stop, total)
        start, stop, piece, weight = start[order], stop[order], piece[order], weight[order]
        depth = np.zeros(total, np.uint16)
        depth[place] = np.arange(len(place)) - np.repeat(np.cumsum(own) - own, own)
        depth[head + own] = own
        ways = np.full(total, -np.inf)
        ways[head] = 0
        depths = depth[stop]
        by_depth = np.argsort(depths, kind="stable")
        cuts = np.cumsum(np.bincount(depths, minlength=WIDE + 1))
        begins, costs, into = start[by_depth], weight[by_depth], stop[by_depth]
        heads = np.flatnonzero(np.diff(into, prepend=-1))
        many = np.diff(np.append(heads, len(into)))
        into = into[heads]
        upto = np.searchsorted(heads, cuts)
        parts = np.empty(len(start))
        for a, b, i, j in zip(cuts, cuts[1:], upto, upto[1:], strict=False):
            if a == b:
                break
            value = ways[begins[a:b]] + costs[a:b]
            group, sizes = heads[i:j] - a, many[i:j]
            top = np.maximum.reduceat(value, group)
            scaled = np.exp(value - np.repeat(top, sizes))
            sums = np.add.reduceat(scaled, group)
            ways[into[i:j]] = top + np.log(sums)
            parts[a:b] = scaled / np.repeat(sums, sizes)
        share = np.empty(len(start))
        share[by_depth] = parts
        # the edges into a place share the unit interval behind its number
        group = np.flatnonzero(np.diff(stop, prepend=-1))
        many = np.diff(np.append(group, len(stop)))
        running = np.cumsum(share)
        limit = stop + np.minimum(running - np.repeat(running[group] - share[group], many), 1)
        limit[np.append(group[1:], len(stop)) - 1] = stop[np.append(group[1:], len(stop)) - 1] + 1.0

        # backward: a draw for every segment of every text that has not come to its front
        todo = np.argsort(kind, kind="stable")
        state, drawn, step = (head + own)[kind[todo]], [], 0
        while len(todo):
            e = np.searchsorted(limit, state + _uniform(seed[todo], step), "right")
            drawn.append((todo, piece[e], padded[start[e]]))
            state = start[e]
            more = state > head[kind[todo]]
            todo, state, step = todo[more], state[more], step + 1
        steps = np.repeat(np.arange(len(drawn)), [len(d[0]) for d in drawn])
        segment, pieces, letters = (np.concatenate(c) for c in zip(*drawn, strict=True))
        return segment, steps, pieces, letters

    def _alone(self, cps: np.ndarray, seed: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Piece and first character of all draws of one segment, from its end to its front."""
        n = len(cps)

        def into(a: int, b: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """The edges that stop behind ``a`` and up to ``b``, by stop; places count from the first one given."""
            low = max(0, a - self.longest)
            start, stop, piece, weight = self.edges(cps[low:b], np.full(b - low, b - low))
            order = np.argsort(stop, kind="stable")
            order = order[np.searchsorted(stop[order], a - low, "right") :]
            return low, start[order], stop[order], piece[order], weight[order]

        # forward: every place can be reached, since each character is a piece or bytes
        ways = np.zeros(n + 1)
        for a in range(0, n, window):
            b = min(a + window, n)
            low, start, stop, _, weight = into(a, b)
            known, begins, costs = ways[low : a + 1].tolist(), start.tolist(), weight.tolist()
            group = [*np.flatnonzero(np.diff(stop, prepend=-1)).tolist(), len(stop)]
            for i, j in zip(group, group[1:], strict=False):
                values = [known[s] + w for s, w in zip(begins[i:j], costs[i:j], strict=True)]
                top = max(values)
                known.append(top + math.log(sum(math.exp(v - top) for v in values)))
            ways[a + 1 : b + 1] = known[a + 1 - low :]

        # backward
        pieces, places, state, step = [], [], n, 0
        for a in range((n - 1) // window * window, -1, -window):
            if state <= a:
                continue
            b = min(a + window, n)
            low, start, stop, piece, weight = into(a, b)
            upto = np.cumsum(np.exp(ways[start + low] + weight - ways[stop + low])).tolist()
            first = np.searchsorted(stop, np.arange(a + 1, b + 2) - low).tolist()
            begins, chosen = start.tolist(), []
            numbers = _uniform(seed, np.arange(step, step + b - a)).tolist()
            while state > a:
                i, j = first[state - a - 1], first[state - a]
                before = upto[i - 1] if i else 0.0
                e = bisect_right(upto, before + numbers[len(chosen)] * (upto[j - 1] - before), i, j - 1)
                chosen.append(e)
                state = low + begins[e]
            step += len(chosen)
            pieces.append(piece[chosen])
            places.append(start[chosen] + low)
        return np.concatenate(pieces), cps[np.concatenate(places)]

    def _with_bytes(self, ids: np.ndarray, letters: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that have no piece as the pieces of their bytes."""
        at = np.flatnonzero(ids < 0)
        if not len(at):
            return ids, per_text
        codes = [self.byte_ids[np.frombuffer(chr(MARK if c == LITERAL_MARK else c).encode(), np.uint8)] for c in letters[at].tolist()]
        more = np.ones(len(ids), np.int64)
        more[at] = [len(c) for c in codes]
        text = np.repeat(np.arange(len(per_text)), per_text)
        out = np.repeat(ids, more)
        out[out < 0] = np.concatenate(codes)
        return out, np.bincount(text, more, len(per_text)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ``ids`` stand for, and where each id's bytes end among them."""
        size = self.raw_sizes[ids]
        ends = np.cumsum(size)
        at = np.repeat((self.raw_ends[ids] - ends).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.raw[at], ends


def lattice(path: str, temperature: float) -> Lattice:
    """The worker's lattice; kept on the sentencepiece module, which lives as long as the worker."""
    import sentencepiece

    kept = sentencepiece.__dict__.setdefault("_lattices", {})
    if (path, temperature) not in kept:
        kept[path, temperature] = Lattice(path, temperature)
    return kept[path, temperature]


def encode(docs: DataFrame, model: str, seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """doc_id, ids (array of piece ids), one sampled segmentation of every row of ``docs`` (doc_id, text).

    The sample depends on doc_id, ``seed`` and the text only: repeated rows get equal ids. A null text is empty and has
    no ids; null doc_ids are one key. Other columns are not carried. An empty table gives none.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model, temperature)
        for batch in batches:
            for block in blocks(batch, "text", CHARS):
                ids, many = pieces.block(block.column("text"), np.asarray(block.column("key")).view(np.uint64))
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(many)]).astype(np.int32), ids.astype(np.int32))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), lists], names=["doc_id", "ids"])

    keyed = bounded_batches(docs, BATCH).select("doc_id", text_of("text").alias("text"), F.xxhash64("doc_id", F.lit(seed)).alias("key"))
    return keyed.mapInArrow(sample, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text of every row of ``encoded`` (doc_id, ids); null ids are an empty text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model, 1.0)
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                column = part.column("ids")
                offsets = np.asarray(column.offsets)
                data, ends = pieces.decode(np.asarray(column.flatten()))
                bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
                texts = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "text"])

    rows = bounded_batches(encoded, BATCH).select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(read, "doc_id long, ids array<int>, text string")
