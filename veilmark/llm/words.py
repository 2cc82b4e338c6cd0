"""Words of whole texts as 64-bit hashes, made by array operations on the UTF-8 bytes of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


_STEPS = np.arange(1, 17, dtype=np.uint64) * _ODD
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD | U(1), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1024)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, with a line feed after each text, and where each text starts and the last one ends."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.empty(0, dtype=np.uint8)
    ends = offsets[1:] - offsets[0]
    starts = np.concatenate([[0], ends]).astype(np.int64) + np.arange(n + 1)
    out = np.full(len(raw) + n, 10, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[starts[1:] - 1] = False
    out[keep] = raw
    return out, starts


#: Space and all ASCII that is neither letter nor digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(column: pa.Array, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text with the total at the end, bytes, start byte and end byte of each word).

    Words are runs of bytes outside `gaps`, by default space and 0x09-0x0D; A-Z counts as a-z. A null text has none.
    """
    data, starts = text_bytes(column)
    gap = gaps[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[::2], edge[1::2]  # every text ends with a line feed, so each word has its end
    if not len(first):
        return np.empty(0, dtype=np.uint64), np.zeros(len(starts), dtype=np.int64), data, first, last
    length = last - first
    global _POWERS
    if (most := int(length.max())) >= len(_POWERS):
        _POWERS = _powers(2 * most)
    inside = np.flatnonzero(~gap)
    begin = np.cumsum(length) - length
    place = np.arange(len(inside)) - np.repeat(begin, length)
    hashes = mix(np.add.reduceat(_BYTE[data[inside]] * _POWERS[place], begin) + length.astype(np.uint64))
    return hashes, np.searchsorted(first, starts), data, first, last


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words; a shorter text has one, of all its words."""
    count = max(0, len(hashes) - n + 1)
    runs = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        runs = mix(runs + hashes[k : k + count] + _STEPS[k % len(_STEPS)])
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                whole = mix(whole + hashes[k : k + 1] + _ODD)
            out.append(whole)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
