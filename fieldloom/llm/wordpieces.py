"""Token ids of many texts, word by word.

The tokenizer splits at white space before all else, so the ids of a text are the ids of its words, one after the
other. Each distinct word of a block is encoded once, and the blocks are put together with NumPy. The ids are the
tokenizer's own: this module only decides how often to ask it.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: characters of text in a block, and words a worker remembers between blocks; both only bound memory
BLOCK_CHARS = 8 << 20
WORDS = 600_000
#: punctuation that the tokenizer always splits from the letters before it; nothing behind it can go with it
TAIL = string.punctuation
#: letters that every version of the tables knows, and whose lower case is one such letter
SETTLED = r"a-zA-Z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
#: how the tokenizer of the word-end kind finds its words: white space that is one space, then the pattern
BEFORE = (
    {"Regex": r"\s+"},
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)


def _listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids by a word-end tokenizer (its tokens mark the end of a word by ``</w>``, its pre-tokenizer splits at white space)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.letters = self._letters()
        self.marks = tuple(t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values())
        self.forget()

    def _letters(self):
        """The tokenizer for words of settled letters, split at spaces: they need neither composing nor the pattern."""
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Lowercase
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        spec = json.loads(self.tokenizer.to_str())
        normalizer, before = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        if [s.get("type") for s in normalizer.get("normalizers", ())] != ["NFC", "Replace", "Lowercase"]:
            return self.tokenizer
        if (normalizer["normalizers"][1]["pattern"], before.get("pretokenizers")) != BEFORE:
            return self.tokenizer
        out = Tokenizer.from_str(json.dumps(spec))
        out.normalizer, out.pre_tokenizer = Lowercase(), Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def forget(self) -> None:
        self.rows: dict[str, int] = {"": 0}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        #: a word's ids are those of the pool from its bound to the next one
        self.bounds = np.zeros(1 << 12, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Remember words whose ids end at ``ends`` of ``ids``."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        n = len(self.rows)
        while n + len(words) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.rows.update(zip(words, range(n, n + len(words)), strict=True))
        self.bounds[n + 1 : n + len(words) + 1] = ends + self.used
        self.used += len(ids)

    def _encode(self, words: list[str]) -> None:
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._add(part, np.array([i for ids in got for i in ids], np.uint32), np.cumsum([len(ids) for ids in got]))

    def _encode_letters(self, words: list[str], tokenizer) -> None:
        """Words of letters only: each gives one word end, so that many can be encoded as one text."""
        for k in range(0, len(words), 4000):
            part = words[k : k + 4000]
            texts = [" ".join(part[j : j + 200]) for j in range(0, len(part), 200)]
            ids = np.array([i for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                self._add(part, ids, ends)
            else:
                self._encode(part)

    def _rows_of(self, words: pa.Array) -> np.ndarray:
        """The remembered row of each of ``words``, which are distinct."""
        listed = _listed(words)
        rows = np.fromiter(map(self.rows.get, listed, repeat(-1)), np.int32, len(listed))
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            new = words.take(pa.array(fresh))
            settled = pc.match_substring_regex(new, f"^[{SETTLED}]+$")
            self._encode_letters(_listed(new.filter(settled)), self.letters)
            odd = new.filter(pc.invert(settled))
            letters = pc.match_substring_regex(odd, r"^\pL+$")
            self._encode_letters(_listed(odd.filter(letters)), self.tokenizer)
            self._encode(_listed(odd.filter(pc.invert(letters))))
            rows[fresh] = np.fromiter(map(self.rows.__getitem__, _listed(new)), np.int32, len(new))
        return rows

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (no nulls), and the number of ids of each."""
        if len(self.rows) > WORDS:
            self.forget()
        for mark in set(self.marks):  # a special token's text may stand for one id: ask for each text as it is
            special = pc.match_substring(texts, mark)
            if pc.any(special).as_py():
                got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
                return np.concatenate([*got, np.zeros(0, np.uint32)]), np.array([len(g) for g in got], np.int64)
        parts = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(parts.offsets, np.int64)
        coded = parts.flatten().dictionary_encode()
        words = pc.ascii_lower(coded.dictionary)
        base = pc.utf8_rtrim(words, characters=TAIL)
        plain = pc.match_substring_regex(base, r"^\pL+$")
        base = pc.if_else(plain, base, words)
        tail = pc.if_else(plain, pc.utf8_slice_codeunits(words, 0, 0), words)
        cut = np.asarray(pc.utf8_length(base))
        tail = pa.array([w[c:] for w, c in zip(_listed(words), cut.tolist(), strict=True)], pa.string())
        segments = np.zeros((len(words), 2), np.int32)
        for column, values in enumerate((base, tail)):
            d = values.dictionary_encode()
            if len(d):
                segments[:, column] = self._rows_of(d.dictionary)[np.asarray(d.indices)]
        bound = self.bounds[: len(self.rows) + 1]
        # first the ids of each distinct word, then those of all words
        pool, _, sizes = gathered(self.pool, bound[:-1], np.diff(bound), segments.ravel())
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        ids, ends, _ = gathered(pool.astype(self.kind), np.cumsum(sizes) - sizes, sizes, np.asarray(coded.indices))
        upto = np.concatenate([[0], ends])[bounds]
        return ids, np.diff(upto)


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of ``pool`` that ``rows`` name, one after the other; where each ends; how long each is."""
    lens = lengths[rows]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 2**31 else np.int64
    at = np.repeat((starts[rows] - (ends - lens)).astype(kind), lens)
    at += np.arange(total, dtype=kind)
    return pool[at], ends, lens


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for ``path``. It is kept on the tokenizers module, which lives as long as the worker."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_word_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def blocks(batch: pa.RecordBatch, column: str, chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``chars`` bytes of text each; a longer text is one slice."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    place = (np.cumsum(sizes) - sizes) // chars
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
