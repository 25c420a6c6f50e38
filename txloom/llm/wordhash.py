"""Words and word windows of many texts at once, as 64-bit hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. Everything works on whole Arrow string
arrays in numpy, a few MB at a time, so memory does not depend on how texts are spread over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once (a longer single text is taken whole).
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.arange(1, 257, dtype=np.uint64)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += np.uint64(32)
WORD, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts data[bounds[i]:bounds[i + 1]], and where each text's words begin (n + 1).
    space: for each byte, whether it lies between words."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~space[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = bounds[:-1][bounds[:-1] < n]
    begins[edge] = word[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    place = np.arange(n, dtype=np.int32)
    place[starts[0] :] -= np.repeat(starts.astype(np.int32), np.diff(np.append(starts, n)))
    place[~word] = 0
    values = (_LOWER if lower else _PLAIN)[data]
    values[~word] = 0
    values *= powers(WORD, int(place.max()) + 1)[place]
    return mixed(np.add.reduceat(values, starts)), np.searchsorted(starts, bounds)


def windows(h: np.ndarray, size: int, base: int = FIRST) -> np.ndarray:
    """Hash of the `size` words from each position on (len(h) - size + 1 of them, over text bounds too)."""
    n = len(h)
    if n < size:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(base, n), out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * powers(pow(base, -1, 1 << 64), n - size + 1))


def slices(texts: pa.Array | pa.ChunkedArray, lower: bool = False, space: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, where each row's words begin) over consecutive rows; null texts have no words."""
    row = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        chunk = pc.fill_null(chunk, "").cast(pa.large_string())
        if not len(chunk):
            continue
        _, at, held = chunk.buffers()
        bounds = np.frombuffer(at, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, "right")) - 1)
            h, own = word_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower, space)
            yield row + i, h, own
            i = j
        row += len(chunk)


def word_count(texts: pa.Array) -> int:
    """How many words all texts have together."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return 0
    _, at, held = texts.buffers()
    bounds = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    word = ~_SPACE[np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]]] if held is not None and held.size else np.empty(0, bool)
    edge = np.unique(bounds[1:-1] - bounds[0])
    edge = edge[(edge > 0) & (edge < len(word))]  # words that meet where one text ends and the next begins
    return int(word[:1].sum() + np.count_nonzero(word[1:] & ~word[:-1]) + np.count_nonzero(word[edge] & word[edge - 1]))


def ordered(h: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes: places ride in the low bits of a plain sort, several times faster than an argsort;
    the few hashes that differ in those bits alone are put right after it."""
    bits = np.uint64(max(1, len(h)).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    keys = h & ~mask
    keys |= np.arange(len(h), dtype=np.uint64)
    keys.sort()
    at = (keys & mask).astype(np.int64)
    found = h[at]
    return at[np.argsort(found, kind="stable")] if (found[1:] < found[:-1]).any() else at


def split_by_hash(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted hashes change from one of `buckets` equal ranges to the next (buckets + 1 places)."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
