"""Texts cut at spaces into chunks that tokenizers treat one by one, with each distinct chunk of a block named once.

A space begins a chunk unless it stands inside white space: every pattern of the byte-level kind begins a word at a space
that follows a black character, and at a space before one. Joining chunks that could stand alone changes no result, so
characters that only may be white space count as such.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: characters that are white space in any of the libraries' tables
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def chunks(texts: pa.Array, led: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks of ``texts`` (no nulls); the chunk at each place; each text's bounds among the places.

    With ``led`` every text is read with a space before it, and runs of spaces are not cut at all, as word-piece
    vocabularies with space marks ask for.
    """
    parts = pc.split_pattern(texts, " ")
    bounds = np.asarray(parts.offsets, np.int64)
    bounds = bounds - bounds[0]
    coded = parts.flatten().dictionary_encode()
    values, at = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    if not len(at):
        return [], at, bounds
    empty = np.asarray(pc.equal(values, ""))
    begins = empty | np.asarray(pc.match_substring_regex(values, "^" + WHITE))
    ends = empty | np.asarray(pc.match_substring_regex(values, WHITE + "$"))
    first = np.zeros(len(at), bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    joined = np.zeros(len(at), bool)
    joined[1:] = ends[at[:-1]] & begins[at[1:]]
    if led:
        joined[1:] |= empty[at[:-1]]
    joined[first] = False
    listed = values.to_pylist()
    if joined.any():
        heads = np.flatnonzero(~joined)
        sizes = np.diff(np.append(heads, len(at)))
        place = np.cumsum(~joined) - 1
        long = np.flatnonzero(sizes > 1)
        known: dict[str, int] = {}
        fresh = np.empty(len(long), np.int64)
        for k, (a, n) in enumerate(zip(heads[long].tolist(), sizes[long].tolist(), strict=True)):
            text = " ".join([listed[v] for v in at[a : a + n].tolist()])
            if text not in known:
                known[text] = len(listed)
                listed.append(text)
            fresh[k] = known[text]
        at = at[heads]
        at[long] = fresh
        first = first[heads]
        bounds = np.append(place, len(heads))[bounds]
    codes = at * 2 + (True if led else ~first)
    seen = np.zeros(2 * len(listed), bool)
    seen[codes] = True
    distinct = np.flatnonzero(seen)
    row = np.zeros(len(seen), np.int64)
    row[distinct] = np.arange(len(distinct))
    names = [(" " + listed[c >> 1]) if c & 1 else listed[c >> 1] for c in distinct.tolist()]
    return names, row[codes], bounds
