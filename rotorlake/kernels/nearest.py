"""The nearest of many places in a plane, exactly, for many points at once."""

from __future__ import annotations

import numpy as np

#: Places of a leaf; pairs of a point and a box that a search looks at together.
LEAF, FRONT = 16, 1 << 17


class Places:
    """A balanced tree of boxes around places, which are named by their number.

    Of equally distant places the one with the smallest number is nearest. What a search holds
    is bounded, whatever the number of candidates.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        xy = np.column_stack([x, y]).astype(float)
        self.depth = max(0, (-(-len(xy) // LEAF) - 1).bit_length())
        order, cuts = np.arange(len(xy)), [0, len(xy)]
        for _ in range(self.depth):
            halves = [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, half = order[a:b], (b - a) // 2
                order[a:b] = own[np.argpartition(xy[own, np.argmax(np.ptp(xy[own], axis=0))], half)]
                halves += [a + half, b]
            cuts = halves
        self.start, self.end = np.array(cuts[:-1]), np.array(cuts[1:])
        self.xy, self.number = xy[order], order
        low, high = np.minimum.reduceat(self.xy, self.start), np.maximum.reduceat(self.xy, self.start)
        levels = [(low, high)]
        while len(low) > 1:
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            levels.append((low, high))
        self.levels = levels[::-1]

    def _to_box(self, p: np.ndarray, level: int, box: np.ndarray) -> np.ndarray:
        """Distances to boxes; as floats, too, no more than that to any place in the box."""
        low, high = (b[box] for b in self.levels[level])
        d = np.maximum(np.maximum(low - p, p - high), 0.0)
        return np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1])

    def _in_leaf(self, p: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distance and number of the nearest place of a leaf, for each pair of a point and a leaf."""
        at = np.minimum(self.start[leaf][:, None] + np.arange((self.end - self.start).max()), self.end[leaf][:, None] - 1)
        d = p[:, None, :] - self.xy[at]
        size = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])
        least = size.min(axis=1)
        return least, np.where(size == least[:, None], self.number[at], len(self.number)).min(axis=1)

    def search(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, number) of the nearest place of each point."""
        p = np.column_stack([x, y]).astype(float)
        distance, number = np.empty(len(p)), np.empty(len(p), np.int64)
        for a in range(0, len(p), FRONT // LEAF):
            part = slice(a, a + FRONT // LEAF)
            distance[part], number[part] = self._search(p[part])
        return distance, number

    def _search(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        box = np.zeros(len(p), np.int64)
        for level in range(1, self.depth + 1):
            box = 2 * box + (self._to_box(p, level, 2 * box + 1) < self._to_box(p, level, 2 * box))
        distance, number = self._in_leaf(p, box)
        todo = [(0, np.arange(len(p)), np.zeros(len(p), np.int64))]
        while todo:
            level, own, box = todo.pop()
            if len(own) > FRONT:
                half = len(own) // 2
                todo += [(level, own[half:], box[half:]), (level, own[:half], box[:half])]
                continue
            near = self._to_box(p[own], level, box) <= distance[own]
            own, box = own[near], box[near]
            if level < self.depth:
                if len(own):
                    todo.append((level + 1, np.repeat(own, 2), np.column_stack([2 * box, 2 * box + 1]).ravel()))
                continue
            for a in range(0, len(own), FRONT // LEAF):
                part = own[a : a + FRONT // LEAF]
                d, n = self._in_leaf(p[part], box[a : a + FRONT // LEAF])
                order = np.lexsort((n, d, part))
                order = order[np.diff(part[order], prepend=-1) != 0]
                part, d, n = part[order], d[order], n[order]
                better = (d < distance[part]) | ((d == distance[part]) & (n < number[part]))
                distance[part[better]], number[part[better]] = d[better], n[better]
        return distance, number
