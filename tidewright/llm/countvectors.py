"""Group counts of token sets as points, and a packed R-tree over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUPS = 256
LEAF, FAN = 16, 16
_ALL = np.iinfo(np.uint16).max


def counts(tokens: np.ndarray) -> np.ndarray:
    """How many distinct tokens fall in each group. A count that does not fit makes the point bound nothing."""
    found = np.bincount((tokens >> np.uint64(32)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS)
    return np.full(GROUPS, _ALL, np.uint16) if found.max() >= _ALL else found.astype(np.uint16)


def pack(points: np.ndarray) -> bytes:
    """A point as bytes, one per group where all counts fit."""
    return (points.astype(np.uint8) if points.max() < 256 else points).tobytes()


def unpack(packed: list[bytes]) -> np.ndarray:
    """The points of packed ones, one row each."""
    out = np.empty((len(packed), GROUPS), np.uint16)
    for i, data in enumerate(packed):
        out[i] = np.frombuffer(data, np.uint8 if len(data) == GROUPS else np.uint16)
    return out


def minima(points: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of every point with every box corner: no set in the box shares more tokens with the point's set."""
    out = np.empty((len(points), len(boxes)), np.int64)
    for at in range(0, len(points), 16):
        out[at:at + 16] = np.minimum(points[at:at + 16, None, :], boxes[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def enough(shared, one, other, percent: int):
    """Whether ``100 * shared >= percent * union`` for sets of these sizes."""
    return (100 + percent) * shared >= percent * (one + other)


class CountTree:
    """Points packed sort-tile-recursively: by size, then by the weight of the coordinates' halves, leaves of 16, nodes of 16 leaves.

    A box is bounded by the largest value of each coordinate and by the smallest and largest set size under it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = max(LEAF, int(len(points) ** 0.5))
        by_size = np.argsort(sizes, kind="stable")
        rank = np.empty(len(points), np.int64)
        rank[by_size] = np.arange(len(points))
        self.order = np.lexsort((points[:, :GROUPS // 2].sum(axis=1, dtype=np.int64), rank // slab))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, low, high, step = self.points, self.sizes, self.sizes, LEAF
        while len(top) > 1 or not self.levels:
            at = np.arange(0, len(top), step)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))
            step = FAN

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query, member) numbers whose summed minima allow the similarity."""
        for at in range(0, len(points), 64):
            some, size = points[at:at + 64], sizes[at:at + 64]
            nodes = np.arange(len(self.levels[-1][0]))
            for level in range(len(self.levels) - 1, -1, -1):
                top, low, high = (x[nodes] for x in self.levels[level])
                reach = (100 * high[None, :] >= percent * size[:, None]) & (100 * size[:, None] >= percent * low[None, :])
                reach &= enough(minima(some, top), size[:, None], low[None, :], percent)
                nodes = nodes[reach.any(axis=0)]
                width, count = (FAN, len(self.levels[level - 1][0])) if level else (LEAF, len(self.points))
                nodes = (nodes[:, None] * width + np.arange(width)).ravel()
                nodes = nodes[nodes < count]
            near = (100 * self.sizes[nodes][None, :] >= percent * size[:, None]) & (100 * size[:, None] >= percent * self.sizes[nodes][None, :])
            near &= enough(minima(some, self.points[nodes]), size[:, None], self.sizes[nodes][None, :], percent)
            query, member = np.nonzero(near)
            yield query + at, self.order[nodes[member]]
