"""Vectorised word scanning of UTF-8 text columns: word bounds and 64-bit word hashes without a loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

IS_GAP = np.zeros(256, dtype=bool)
IS_GAP[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Spans of more bytes are hashed one by one by the xxhash library.
LONG = 64
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (a public finaliser of the xorshift-multiply kind)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end). Eight bytes at a time are mixed in; up to eight, different spans of a length differ.

    Memory beyond the spans' own is one copy of data, however long a span is.
    """
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    # the eight bytes from every place on, as one little-endian number
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, k = np.flatnonzero((lengths > 0) & (lengths <= LONG)), 0
    while len(live):
        part = eight[starts[live] + k]
        left = lengths[live] - k
        short = left < 8
        part[short] &= _KEEP[left[short]]
        out[live] = mix(out[live] ^ part)
        k += 8
        live = live[left > 8]
    view = memoryview(padded)
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]])
    return out


@dataclass
class Words:
    """Words of consecutive texts: byte bounds, the row of each, and the first word of each row (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray


def scan(data: np.ndarray, offsets: np.ndarray) -> Words:
    gap = IS_GAP[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.ones(len(data) + 1, dtype=bool)
    before[1:] = gap
    starts = np.flatnonzero(~gap & (before[:-1] | cut[:-1]))
    after = np.ones(len(data), dtype=bool)
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | cut[1:])) + 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)
