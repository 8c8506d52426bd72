"""Word shingles of many texts as 64-bit hashes, in NumPy over the texts' bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_random = np.random.Generator(np.random.PCG64(20240229))
#: a random number for each byte, A-Z as a-z, white space as nothing
BYTES = _random.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTES[SPACE] = 0
#: odd multipliers of the words of a shingle
WORDS = _random.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """Multipliers by place in a word."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``texts`` (no nulls), and each text's bounds in them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of ``texts``, and each text's bounds among the words."""
    data, bounds = bytes_of(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    black = ~SPACE[data]
    start = black.copy()
    start[1:] &= ~black[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    start[inner] = black[inner]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    place = np.arange(at[0], len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    values = BYTES[data[at[0] :]] * _powers(int(place.max()) + 1)[place]
    return mixed(np.add.reduceat(values, at - at[0])), np.searchsorted(at, bounds)


#: bytes of texts that are hashed at once; this only bounds the memory of the arrays over their bytes
AT_ONCE = 1 << 20


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text (no nulls).

    Words are what stands between the six ASCII white space characters, A-Z as a-z. A text of fewer words is one
    shingle, a text without words has none.
    """
    places = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(texts)]
    return [s for a, b in zip(edges, edges[1:], strict=False) for s in _sets(texts.slice(a, b - a), words)]


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    hashes, bounds = word_hashes(texts)
    whole = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        whole += hashes[k : k + len(whole)] * WORDS[k]
    whole = mixed(whole)
    out = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            out.append(mixed((hashes[a:b] * WORDS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingles."""
    return int((mixed(shingles * STEP + np.uint64(len(shingles))).sum(dtype=np.uint64)).astype(np.int64))
