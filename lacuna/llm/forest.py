"""Union of labels inside a task: what links leave of a block is a spanning forest."""

from __future__ import annotations

import numpy as np


class Forest:
    """Labels of ``n`` items; ``link`` joins many pairs at once and remembers those that joined something."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.joined: list[np.ndarray] = []

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return
        ends = np.stack([np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])], 1)
        pairs, at = np.unique(ends, axis=0, return_index=True)
        parent: dict[int, int] = {}
        used = []

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        for k, (x, y) in enumerate(pairs.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                used.append(k)
        to = np.arange(len(self.label))
        for x in parent:
            to[x] = root(x)
        self.label = to[self.label]
        some = apart[at[used]]
        self.joined.append(np.stack([i[some], j[some]]))

    def pairs(self) -> np.ndarray:
        """(2, m): linked pairs that make the forest."""
        return np.concatenate([np.zeros((2, 0), np.int64), *self.joined], 1).astype(np.int64)
