"""A forest of random-projection trees for unit vectors, searched through one priority queue."""

from __future__ import annotations

import numpy as np


class Forest:
    """Trees over unit vectors. A node has a direction and a threshold; a child below 0 is the leaf ``-1 - child``.

    Directions are random projections drawn towards the spread of the node's points (a random vector is multiplied
    by their covariance twice); of ``tries`` drawn, the one whose middle has the emptiest band is kept, and the
    threshold lies in that band, so few close pairs are parted. Leaves are numbered through all trees.
    """

    def __init__(self, sample: np.ndarray, leaves: int, trees: int, seed: int = 1, tries: int = 12, slack: float = 0.15):
        self.rng = np.random.default_rng(seed)
        self.tries, self.slack = tries, slack
        self.weights: list[np.ndarray] = []
        self.bounds: list[float] = []
        self.children: list[list[int]] = []
        self.n_leaves = 0
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.roots = np.array([self._grow(sample, depth) for _ in range(trees)], np.int64)
        width = sample.shape[1]
        self.w = np.array(self.weights, np.float32).reshape(-1, width)
        self.t = np.array(self.bounds, np.float32)
        self.c = np.array(self.children, np.int64).reshape(-1, 2)
        del self.rng, self.weights, self.bounds, self.children

    def _direction(self, x: np.ndarray) -> tuple[np.ndarray, float] | None:
        centred = x - x.mean(0)
        best: tuple[float, np.ndarray, float] | None = None
        n = len(x)
        lo, hi = int(n * (0.5 - self.slack)), int(n * (0.5 + self.slack))
        band = max(1, n // 50)
        for _ in range(self.tries):
            g = self.rng.standard_normal(x.shape[1]).astype(np.float32)
            for _ in range(2):
                g = centred.T @ (centred @ g)
                norm = np.linalg.norm(g)
                if not norm > 0:
                    return None
                g /= norm
            p = np.sort(x @ g)
            widths = p[lo + band : hi + band] - p[lo:hi] if hi + band <= n else p[hi:hi] - p[hi:hi]
            if not len(widths) or p[-1] <= p[0]:
                continue
            k = int(np.argmax(widths))
            score = float(widths[k] / (p.std() + 1e-12))
            if best is None or score > best[0]:
                inner = p[lo + k : lo + k + band + 1]
                gap = int(np.argmax(np.diff(inner)))
                best = score, g, float((inner[gap] + inner[gap + 1]) / 2)
        return None if best is None else best[1:]

    def _grow(self, x: np.ndarray, depth: int) -> int:
        split = self._direction(x) if depth > 0 and len(x) >= 8 else None
        if split is None:
            self.n_leaves += 1
            return -self.n_leaves
        node = len(self.bounds)
        self.weights.append(split[0])
        self.bounds.append(split[1])
        self.children.append([0, 0])
        above = x @ split[0] > split[1]
        self.children[node] = [self._grow(x[~above], depth - 1), self._grow(x[above], depth - 1)]
        return node

    def search(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, int]:
        """(leaves, number of trees): for each vector its leaf in every tree, then ``probes`` further leaves, taken
        from one queue over all trees in which a branch not taken has the greatest margin on its way as priority.
        -1 where the trees have no further leaf."""
        n, trees = len(x), len(self.roots)
        out = np.full((n, trees + probes), -1, np.int64)
        keys: list[np.ndarray] = []  # priorities of branches not taken, a column for each step
        ends: list[np.ndarray] = []

        def descend(node: np.ndarray, before: np.ndarray, column: int) -> None:
            node = node.copy()
            rows = np.flatnonzero(node >= 0)
            while len(rows):
                at = node[rows]
                margin = np.einsum("ij,ij->i", x[rows], self.w[at]) - self.t[at]
                side = (margin > 0).astype(np.int64)
                key, end = np.full(n, np.inf, np.float32), np.full(n, -1, np.int64)
                key[rows] = np.maximum(np.abs(margin), before[rows])
                end[rows] = self.c[at, 1 - side]
                if probes:
                    keys.append(key)
                    ends.append(end)
                node[rows] = self.c[at, side]
                rows = rows[node[rows] >= 0]
            out[:, column] = np.where(node < 0, -1 - node, -1)

        for tree, root in enumerate(self.roots):
            descend(np.full(n, root), np.zeros(n, np.float32), tree)
        used = 0
        for probe in range(probes):
            if not keys:
                break
            key, end = np.stack(keys[used:] if not used else keys, 1), np.stack(ends, 1)
            best = np.argmin(key, 1)
            rows = np.arange(n)
            priority = key[rows, best]
            found = np.isfinite(priority)
            for j, column in enumerate(keys):
                column[best == j] = np.inf
            start = np.where(found, end[rows, best], 0)
            if not found.any():
                break
            descend(np.where(found, start, -1), np.where(found, priority, 0).astype(np.float32), trees + probe)
            out[~found, trees + probe] = -1
        return out, trees
