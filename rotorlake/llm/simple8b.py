"""Simple-8b: 64-bit words whose top four bits select how many ids of which width follow.

Selectors 0 to 13 pack COUNTS ids of BITS bits. Selector 15 escapes one id of 2**60 or more:
its payload is the id's place in a list of 64-bit exceptions. Blocks of BLOCK ids begin at
known words, so that blocks pack and unpack independently and all at once in numpy. A
block's last word may hold zeros past its end; the number of ids says where it ends.
"""

from __future__ import annotations

import numpy as np

COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE, BLOCK, PAD = 15, 1024, 64
_TAKES = np.concatenate([COUNTS, [0, 1]])
_ROW = BLOCK + PAD


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block (and one past the last), exceptions."""
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, _ROW), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[: len(ids)] = ids
    grid[:, :BLOCK] = full.reshape(blocks, BLOCK)
    width = np.searchsorted(np.uint64(1) << BITS.astype(np.uint64), grid.ravel(), "right").astype(np.uint8).reshape(grid.shape)
    best = np.where(width == len(COUNTS), np.uint8(ESCAPE), np.uint8(len(COUNTS) - 1))
    # windows[k]: the largest class among 2**k ids
    windows = [width]
    while 2 << (len(windows) - 1) <= COUNTS[0]:
        step, w = 1 << (len(windows) - 1), windows[-1].copy()
        w[:, :-step] = np.maximum(w[:, :-step], w[:, step:])
        windows.append(w)
    for s in range(len(COUNTS) - 2, -1, -1):
        c = int(COUNTS[s])
        k = c.bit_length() - 1
        most, gap = windows[k][:, :BLOCK].copy(), c - (1 << k)
        if gap:
            most = np.maximum(most, windows[k][:, gap : gap + BLOCK])
        best[:, :BLOCK][most <= s] = s
    # all blocks go forward together, a word at a time
    at, lengths = np.zeros(blocks, np.int64), np.full(blocks, BLOCK)
    if blocks:
        lengths[-1] = len(ids) - (blocks - 1) * BLOCK
    live = np.flatnonzero(lengths > 0)
    rows, places, chosen = [], [], []
    while len(live):
        sel = best[live, at[live]]
        rows.append(live)
        places.append(at[live])
        chosen.append(sel)
        at[live] += _TAKES[sel]
        live = live[at[live] < lengths[live]]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    row, place, sel = map(np.concatenate, (rows, places, chosen))
    order = np.lexsort((place, row))
    row, place, sel = row[order], place[order], sel[order]
    first, flat = row * _ROW + place, grid.ravel()
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(len(COUNTS)):
        if len(own := np.flatnonzero(sel == s)):
            lane = np.arange(COUNTS[s])
            words[own] |= np.bitwise_or.reduce(flat[first[own][:, None] + lane] << (lane * BITS[s]).astype(np.uint64), axis=1)
    escaped = np.flatnonzero(sel == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, np.searchsorted(row, np.arange(blocks + 1)), flat[first[escaped]]


def unpack(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of these blocks (of any consecutive blocks, with ``offsets`` from 0)."""
    blocks = len(offsets) - 1
    out = np.zeros((blocks, _ROW), np.uint64).ravel()
    sel = (words >> np.uint64(60)).astype(np.int64)
    body = words & np.uint64((1 << 60) - 1)
    ends = np.cumsum(_TAKES[sel])
    row = np.repeat(np.arange(blocks), np.diff(offsets))
    before = np.concatenate([[0], ends])[offsets[:-1]] if blocks else np.zeros(0, np.int64)
    first = ends - _TAKES[sel] - before[row] + row * _ROW
    for s in range(len(COUNTS)):
        if len(own := np.flatnonzero(sel == s)):
            lane = np.arange(COUNTS[s])
            mask = np.uint64((1 << int(BITS[s])) - 1)
            out[first[own][:, None] + lane] = body[own][:, None] >> (lane * BITS[s]).astype(np.uint64) & mask
    escaped = np.flatnonzero(sel == ESCAPE)
    out[first[escaped]] = exceptions[body[escaped].astype(np.int64)]
    return out.reshape(blocks, _ROW)[:, :BLOCK].ravel()[:n]
