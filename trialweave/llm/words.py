"""Words of whole Arrow batches as NumPy arrays: spans, 64-bit hashes, shingles.

A batch is worked through in runs of rows of about ``BLOCK`` bytes, so temporaries stay small however many rows
a batch has; a single longer text is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes outside words of letters and digits: ASCII that is neither (bytes of other characters belong to words).
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BYTE = mix(np.arange(1, 257, dtype=U64))
_BASE = 0xA0761D6478BD642F
_POWERS = np.ones(1, dtype=U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 256), _BASE, dtype=U64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS


def blocks(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of runs of rows; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2] if n else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK, side="right")) - 1)
        part = raw[offs[lo] : offs[hi]]
        yield lo, hi, _LOWER[part] if lower else part, offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row (and one beyond) the index of its first word."""
    word = ~space[buf]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offs[1:-1]
    inner = inner[inner < len(buf)]
    begin[inner] = word[inner]
    after = np.ones(len(buf), dtype=bool)
    after[:-1] = ~word[1:]
    after[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(word & after) + 1, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order, don't overlap and aren't empty."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    values = _BYTE[buf[place + np.repeat(starts, lens)]]
    values *= _powers(int(lens.max()))[place]
    return mix(np.add.reduceat(values, at) + lens.astype(U64))


def shingle_sets(words: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles; a shorter row is one shingle, a row without words none."""
    n = len(words)
    many = max(n - width + 1, 0)
    rolled = words[:many].copy()
    for j in range(1, width):
        rolled = rolled * U64(0xBF58476D1CE4E5B9) + words[j : j + many]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= width:
            s = np.sort(rolled[lo : hi - width + 1])
            keep = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif hi > lo:
            h = words[lo]
            for w in words[lo + 1 : hi]:
                h = h * U64(0x94D049BB133111EB) + w
            out.append(mix(np.array([h + U64(hi - lo)], dtype=U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def shingled(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its set of shingles) for each row of a batch."""
    with np.errstate(over="ignore"):
        for lo, _, buf, offs in blocks(texts):
            starts, ends, first = spans(buf, offs)
            for i, s in enumerate(shingle_sets(hashes(buf, starts, ends), first, width)):
                yield lo + i, s
