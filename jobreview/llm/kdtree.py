"""A KD-tree over integer vectors for the highest inner products, exact."""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 64
# Sums below this are exact in double precision.
EXACT = float(1 << 53)


class KDTree:
    """Median splits along the widest side, boxes tight around their points.

    Points are put in id order first and splits are stable, so equal points
    stay in id order and even a shard of equal points halves at every split.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids = points[order], ids[order]
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.least_id: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.lo)
            box = self.points[rows]
            lo, hi = box.min(axis=0), box.max(axis=0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.least_id.append(int(self.ids[rows].min()))
            self.rows.append(rows)
            self.children.append(None)
            if parent >= 0:
                pair = list(self.children[parent] or (0, 0))
                pair[side] = node
                self.children[parent] = tuple(pair)
            if len(rows) > leaf:
                axis = int(np.argmax(hi - lo)) if len(lo) else 0
                by_axis = rows[np.argsort(box[:, axis], kind="stable")] if len(lo) else rows
                half = len(rows) // 2
                todo.append((by_axis[half:], node, 1))
                todo.append((by_axis[:half], node, 0))
        self.lo_box, self.hi_box = np.array(self.lo), np.array(self.hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product of each query with any point of each box."""
        return np.maximum(queries, 0) @ self.hi_box.T + np.minimum(queries, 0) @ self.lo_box.T

    def search(self, query: np.ndarray, own_id: int, k: int, bounds: np.ndarray, floor: float) -> list[tuple]:
        """The ``k`` best (score, id) in this tree, best first, ties to the
        smaller id. ``floor`` is a k-th score already known from elsewhere: what
        lies below it is not looked at, nor returned."""
        best: list[tuple] = []  # a heap with the worst on top: (score, -id)
        agenda = [(-bounds[0], 0)]
        while agenda:
            bound, node = heapq.heappop(agenda)
            bound = -bound
            kth = best[0][0] if len(best) == k else floor
            if bound < kth or bound < floor:
                break  # every other box has a lower bound still
            if len(best) == k and bound == kth and self.least_id[node] > -best[0][1]:
                continue
            pair = self.children[node]
            if pair:
                for child in pair:
                    heapq.heappush(agenda, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = self.points[rows] @ query
            for at in np.flatnonzero(scores >= kth).tolist():
                row = rows[at]
                if self.ids[row] == own_id:
                    continue
                item = (scores[at], -int(self.ids[row]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(score, -minus) for score, minus in sorted(best, reverse=True)]


def exact_dtype(points: np.ndarray, queries: np.ndarray) -> type:
    """Doubles where all sums are exact, Python integers otherwise."""
    if not points.size or not queries.size:
        return np.float64
    most = float(np.abs(points).max()) * float(np.abs(queries).max()) * points.shape[1]
    return np.float64 if most < EXACT else object
