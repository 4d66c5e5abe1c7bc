"""Greedy assignment of modes to tracks by MAC, best first, without the table of all pairs."""

from __future__ import annotations

import heapq

import numpy as np

#: Candidates of a track that are kept at once; doubles of a block of MACs.
KEPT, BLOCK = 64, 1 << 17


def squares(shapes: np.ndarray) -> np.ndarray:
    """Sums of squares of rows, added from the first to the last part."""
    out = np.zeros(len(shapes))
    for d in range(shapes.shape[1]):
        out += shapes[:, d] * shapes[:, d]
    return out


def macs(a: np.ndarray, b: np.ndarray, a2: np.ndarray, b2: np.ndarray, floor: float = 1e-300) -> np.ndarray:
    """MACs of rows of ``a`` with columns of ``b``; parts are added in order, so that equal shapes
    have equal MACs wherever they stand. What isn't a number is 0."""
    out, part = np.zeros((len(a), b.shape[1])), np.empty((len(a), b.shape[1]))
    for d in range(a.shape[1]):
        out += np.multiply(a[:, d, None], b[d], out=part)
    out *= out
    out /= np.maximum(np.multiply(a2[:, None], b2, out=part), floor, out=part)
    out[np.isnan(out)] = 0.0
    return out


def best(table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The KEPT largest entries of each row and their columns, ties by larger column first."""
    if table.shape[1] > KEPT:
        least = np.partition(table, table.shape[1] - KEPT, axis=1)[:, -KEPT]
    else:
        least = np.full(len(table), -np.inf)
    out = []
    for row, low in zip(table, least, strict=True):
        above, same = np.flatnonzero(row > low), np.flatnonzero(row == low)
        at = np.concatenate([same[max(0, len(same) - KEPT + len(above)) :], above])
        at = at[np.lexsort((at, row[at]))[::-1]]
        out.append((row[at], at))
    return out


def assigned(tracks: np.ndarray, held: np.ndarray, found: np.ndarray) -> dict[int, int]:
    """Track to its mode in ``found``: the best MAC first, ties by larger track, then larger mode.

    ``held``: the shape that each of ``tracks`` has now. A track keeps its best candidates and,
    once others have them all, asks for the best of what is left.
    """
    columns, a2, b2 = np.ascontiguousarray(found.T), squares(held), squares(found)
    free, left = np.ones(len(found), bool), np.arange(len(found))
    rows: list = []
    step = max(1, BLOCK // max(1, len(found)))
    for i in range(0, len(held), step):
        rows += best(macs(held[i : i + step], columns, a2[i : i + step], b2))
    at, out = [0] * len(rows), {}
    queue = [(-mac[0], -int(tracks[i]), -int(mode[0]), i) for i, (mac, mode) in enumerate(rows) if len(mode)]
    heapq.heapify(queue)
    while queue and len(out) < len(found):
        _, t, j, i = heapq.heappop(queue)
        if free[-j]:
            out[-t] = -j
            free[-j] = False
            continue
        mac, mode = rows[i]
        later = np.flatnonzero(free[mode[at[i] :]])
        if len(later):
            at[i] += int(later[0])
        else:
            if 2 * (len(found) - len(out)) < len(left):
                keep = free[left]
                left, columns, b2 = left[keep], np.ascontiguousarray(columns[:, keep]), b2[keep]
            row = macs(held[i : i + 1], columns, a2[i : i + 1], b2)
            row[0, ~free[left]] = -1.0
            mac, mode = best(row)[0]
            mode = left[mode]
            mac, mode = rows[i] = mac[mac >= 0], mode[mac >= 0]
            at[i] = 0
        heapq.heappush(queue, (-mac[at[i]], t, -int(mode[at[i]]), i))
    return out
