"""Words, lines and n-grams of many texts at once, in numpy over their UTF-8 bytes.

A separator is always an ASCII byte here, and no byte of a longer UTF-8 character is ASCII,
so that splitting bytes is the same as splitting characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

#: White space that separates words: space and \t to \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes to themselves, A to Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _K + np.uint64(seed))


_BYTE, _PLACE = _stream(1, 256), _stream(2, 1 << 14) | np.uint64(1)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def spans(buffer: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of bytes that aren't ``separator``."""
    inside = ~separator[buffer]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(buffer)]
    first[inner] = inside[inner]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = inner[inner > 0] - 1
    last[before] = inside[before]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (none of them empty), in bounded memory."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    at, filled = 0, np.concatenate([[0], np.cumsum(lengths)])
    with np.errstate(over="ignore"):
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(filled, filled[at] + (1 << 20), "right")) - 1)
            n = lengths[at:upto]
            begin = filled[at:upto] - filled[at]
            place = np.arange(filled[upto] - filled[at]) - np.repeat(begin, n)
            value = _BYTE[buffer[place + np.repeat(starts[at:upto], n)]]
            value *= _PLACE[place & 0x3FFF] + ((place >> 14).astype(np.uint64) << np.uint64(1)) * _K
            out[at:upto] = np.add.reduceat(value, begin) + n.astype(np.uint64) * _K
            at = upto
    return mix(out)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each ``n`` consecutive words; one per place where n words begin."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= _M1
            out += words[k : len(words) - n + 1 + k]
    return mix(out)


def gram_places(text_of: np.ndarray, n: int) -> np.ndarray:
    """True where ``n`` consecutive words begin that are all of one text."""
    if len(text_of) < n:
        return np.zeros(0, bool)
    return text_of[: len(text_of) - n + 1] == text_of[n - 1 :]


def by_text(keys: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """The keys told apart by text, so that equal values mean equal keys of one text."""
    with np.errstate(over="ignore"):
        return mix(keys ^ mix(text_of.astype(np.uint64) + _K))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once; which have occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, more = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    more[order[1:]] = same
    more[order[:-1]] |= same
    return more, before


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """True at the places that windows of ``width`` from ``starts`` cover."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, size), -1)
    return np.cumsum(edge[:-1]) > 0


def per_text(values: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """Sums by text, as integers."""
    return np.bincount(text_of, weights=values, minlength=n).astype(np.int64)
