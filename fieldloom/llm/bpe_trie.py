"""Byte-level BPE by one walk over the trie of the distinct words.

For every prefix of a word the last token of its encoding is settled: of the tokens that end there, it is the one that
goes with the last token of what stands before it, and there is exactly one. So a word's encoding is the way back over
last tokens, and words that share a prefix share all its last tokens. The distinct words of a block, sorted by their
bytes, are their trie in depth-first order: what two neighbours share is the path to the node where they part, and the
walk keeps the last tokens of that path and goes on from there.

Two tokens go together if the merges that build them, undone from the latest to the first, never leave two neighbours
across their border whose own merge would have come earlier.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.chunks import chunks
from fieldloom.llm.common import bounded_batches, text_of
from fieldloom.llm.wordpieces import blocks, gathered

#: bytes of text in a block, and chunks that a worker remembers; both only bound memory
BLOCK = 4 << 20
REMEMBERED = 150_000
#: pairs of tokens that are kept when words are forgotten; this only bounds memory
PAIRS = 1 << 18
#: fixed value: the words of the byte-level kind
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: below this character, what is a letter or a number is the same in every version of the tables
SETTLED = "ɐ"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones for themselves, then the rest."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pool:
    """Lists of numbers, one after the other in one array."""

    def __init__(self):
        self.numbers = np.zeros(1 << 12, np.uint32)
        self.starts, self.counts, self.used = [], [], 0

    def add(self, flat: list[int], counts: list[int]) -> range:
        """The rows of new lists, which stand in ``flat``."""
        while self.used + len(flat) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        self.numbers[self.used : self.used + len(flat)] = flat
        self.starts += (np.cumsum([0, *counts[:-1]]) + self.used).tolist() if counts else []
        self.counts += counts
        self.used += len(flat)
        return range(len(self.counts) - len(counts), len(self.counts))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lists of ``rows``, where each ends, how long each is."""
        return gathered(self.numbers, np.array(self.starts, np.int64), np.array(self.counts, np.int64), rows)


class TokenBytes:
    """The bytes of every id of a byte-level file, which is all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = byte_of_char()
        tokens = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        of_id = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in tokens.items()}
        self.lengths = np.zeros(max(of_id) + 1, np.int64)
        self.lengths[list(of_id)] = [len(b) for b in of_id.values()]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(of_id.get(i, b"") for i in range(len(self.lengths))), np.uint8)

    def text(self, ids: np.ndarray) -> str:
        """The text of ``ids``; ids of no token stand for nothing, and bytes that are no UTF-8 become U+FFFD."""
        ids = ids[ids < len(self.lengths)].astype(np.int64)
        found, _, _ = gathered(self.pool, self.starts, self.lengths, ids)
        return found.tobytes().decode("utf-8", "replace")


class TrieEncoder:
    """Ids of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or odd:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        byte = byte_of_char()
        self.bytes: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in model["vocab"].items()}
        ids = {b: i for i, b in self.bytes.items()}
        self.rank = dict.fromkeys(self.bytes, -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (model["vocab"][t] for t in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = ids[self.bytes[left] + self.bytes[right]]
            self.merges.setdefault((left, right), rank)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), rank
        # a token is used only if merging its own bytes ends with it
        whole = {i for i, b in self.bytes.items() if len(b) == 1}
        for i in sorted(self.parts, key=self.rank.get):
            left, right = self.parts[i]
            if left in whole and right in whole and self._apart(left, right, self.rank[i]):
                whole.add(i)
        self.size = {i: len(self.bytes[i]) for i in whole}
        self._automaton(whole)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that change their surroundings")
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.together: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        #: row of each remembered chunk and word; a chunk's words and a word's ids stand in the pools
        self.chunks: dict[str, int] = {"": 0}
        self.known: dict[str, int] = {}
        self.of_chunk, self.of_word = _Pool(), _Pool()
        self.of_chunk.add([], [0])
        if len(self.together) > PAIRS:  # what is known of pairs of tokens holds for all words
            self.together.clear()
        self.moves = dict(self.children)

    def _automaton(self, whole: set[int]) -> None:
        """States of the tokens' own trie, so that one step a byte tells all tokens that end there.

        ``ends`` has a state's tokens, the longest first; ``children`` the steps inside the trie by state * 256 + byte.
        """
        children: dict[int, int] = {}
        token_at, order = {}, [0]
        for i in whole:
            state = 0
            for byte in self.bytes[i]:
                key = state << 8 | byte
                if key not in children:
                    children[key] = len(order)
                    order.append(len(order))
                state = children[key]
            token_at[state] = i
        below: dict[int, list[tuple[int, int]]] = {}
        for key, state in children.items():
            below.setdefault(key >> 8, []).append((key & 255, state))
        fall, ends, queue = [0] * len(order), [()] * len(order), [0]
        for state in queue:
            for byte, child in below.get(state, ()):
                at = fall[state]
                while state and at and at << 8 | byte not in children:
                    at = fall[at]
                fall[child] = children.get(at << 8 | byte, 0) if state else 0
                own = token_at.get(child)
                ends[child] = ends[fall[child]] if own is None else (own, *ends[fall[child]])
                queue.append(child)
        self.children, self.fall, self.ends = children, fall, ends

    def _step(self, key: int) -> int:
        """The state after a byte that leaves the trie: the longest end of the path that is in it. It is remembered."""
        state, byte = key >> 8, key & 255
        while (found := self.children.get(state << 8 | byte)) is None and state:
            state = self.fall[state]
        self.moves[key] = found = found or 0
        return found

    def _apart(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether no merge across the border of two tokens comes before ``limit`` or the merges that built them."""
        rank, merges, parts = self.rank, self.merges, self.parts
        while True:
            if merges.get((left, right), limit) < limit:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:  # of equal merges the left one comes first, so the right token is undone first
                limit, right = b + 1, parts[right][0]

    def walk(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The ids of ``words``, which are distinct and sorted, one after the other, and the number of ids of each.

        This is the walk over the words' trie, depth first: each of its nodes is met once.
        """
        size, moves, ends, together, apart = self.size, self.moves, self.ends, self.together, self._apart
        coded = [w.encode() for w in words]
        longest = max(map(len, coded), default=0) + 1
        last, states, flat, count, before = [0] * longest, [0] * longest, [], [], b""
        for word in coded:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            state, depth = states[shared], shared
            for byte in word[shared:]:
                depth += 1
                key = state << 8 | byte
                state = moves.get(key)
                if state is None:
                    state = self._step(key)
                states[depth] = state
                for token in ends[state]:
                    rest = depth - size[token]
                    if rest:
                        pair = (last[rest], token)
                        try:
                            goes = together[pair]
                        except KeyError:
                            goes = together[pair] = apart(*pair)
                        if not goes:
                            continue
                    last[depth] = token
                    break
            ids = []
            while depth:
                token = last[depth]
                ids.append(token)
                depth -= size[token]
            flat += ids[::-1]
            count.append(len(ids))
            before = word
        return flat, count

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk, as the tokenizer's own rule cuts them."""
        if chunk.isascii() or max(chunk) < SETTLED:
            return [chunk] if chunk[chunk[0] == " " :].isalpha() else self.words.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(chunk)]

    def chunk_ids(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``names``, which are distinct chunks, one after the other, and where each begins and the last ends."""
        rows = list(map(self.chunks.get, names))
        if None in rows:
            new = [c for c, r in zip(names, rows, strict=True) if r is None]
            words, count = self._rows_of(new)
            self.chunks.update(zip(new, self.of_chunk.add(words, count), strict=True))
            rows = list(map(self.chunks.get, names))
        words, word_ends, _ = self.of_chunk.take(np.array(rows, np.int64))
        return self._ids(words, word_ends)

    def ids_of(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``chunk_ids``, for callers that remember chunks themselves: only words are remembered here."""
        words, count = self._rows_of(names)
        return self._ids(np.array(words, np.int64), np.cumsum(count, dtype=np.int64))

    def _rows_of(self, names: list[str]) -> tuple[list[int], list[int]]:
        """The rows of the words of ``names``, one after the other, and the number of words of each."""
        known, flat, count = self.known, [], []
        for words in map(self.words_of, names):
            flat += words
            count.append(len(words))
        fresh = sorted(w for w in set(flat) if w not in known)  # the order of characters is that of UTF-8
        known.update(zip(fresh, self.of_word.add(*self.walk(fresh)), strict=True))
        return list(map(known.__getitem__, flat)), count

    def _ids(self, words: np.ndarray, word_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, id_ends, _ = self.of_word.take(words)
        return ids, np.concatenate([[0], np.concatenate([[0], id_ends])[word_ends]])

    def make_room(self) -> None:
        if len(self.chunks) > REMEMBERED or len(self.known) > REMEMBERED:
            self.forget()

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (no nulls), and the number of ids of each; added tokens' texts are those tokens."""
        self.make_room()
        inserted = None
        if any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.added):
            listed = texts.to_pylist()
            split = [self.special.split(t) for t in listed]
            marks = [[self.added[m] for m in self.special.findall(t)] for t in listed]
            inserted = np.array([len(s) for s in split], np.int64), marks
            texts = pa.array([p for s in split for p in s], pa.string())
        names, places, bounds = chunks(texts, led=False)
        ids, edges = self.chunk_ids(names)
        ids, ends, _ = gathered(ids, edges[:-1], np.diff(edges), places)
        sizes = np.diff(np.concatenate([[0], ends])[bounds])
        if inserted is None:
            return ids, sizes
        per_text, marks = inserted
        out, total, part, at = [], [], 0, 0
        for n, mark in zip(per_text.tolist(), marks, strict=True):
            total.append(int(sizes[part : part + n].sum()) + len(mark))
            for k in range(n):
                out.append(ids[at : at + sizes[part + k]])
                at += int(sizes[part + k])
                if k < len(mark):
                    out.append(np.array([mark[k]], np.uint32))
            part += n
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.array(total, np.int64)


def kept(kind: type, path: str):
    """The worker's ``kind`` for ``path``. It is kept on the tokenizers module, which lives as long as the worker."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_tries", {})
    if (kind.__name__, path) not in held:
        held[kind.__name__, path] = kind(path)
    return held[kind.__name__, path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers, as binary) and n_tokens of every row of ``docs``.

    The ids are those of the tokenizers library for the file ``path``: the texts of added tokens are those tokens, no
    special tokens are put around a text. A null text is empty and has no ids, as an empty text has. Rows that repeat
    an id or a text are kept, each with its ids; null ids are kept. Other columns are not carried, so their names
    don't matter. An empty table gives no rows. A text is encoded whole, whatever its length, by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(TrieEncoder, path)
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                ids, sizes = coder.block(part.column("text"))
                offsets = np.concatenate([[0], np.cumsum(sizes * 4)])
                data = np.ascontiguousarray(ids, "<u4")
                binary = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), binary.cast(pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "ids", "n_tokens"])

    rows = bounded_batches(docs, 4 << 20).select("doc_id", text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` of ``encode`` (doc_id, ids, n_tokens) with ``decoded``, the text of the ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(TokenBytes, path)
        for batch in batches:
            for part in blocks(batch, "ids", BLOCK):
                texts = [coder.text(np.frombuffer(b, "<u4")) for b in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    slim = rows.select("doc_id", F.coalesce(F.col(ids), F.lit(b"")).alias("ids"), "n_tokens")
    return bounded_batches(slim, 4 << 20).mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")
