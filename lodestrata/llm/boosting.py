"""Gradient-boosted trees for bounded training tables, with isotonic calibration.

Training runs on the driver over a matrix whose row count is bounded by a parameter of the caller. A
fitted model is a few hundred numbers: it is applied to arrays inside workers, or written out as one SQL
expression, so that scoring a table needs neither a join nor a Python worker.
"""

from __future__ import annotations

import numpy as np

from lodestrata.llm.common import ship

ship(__name__)


class Trees:
    """Boosted regression trees on the logistic loss, over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 48, least: float = 2.0, shrink: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.shrink = rounds, depth, rate, bins, least, shrink
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Rows of x are samples; y holds 0 and 1. Without rows, or with one class, the model is a constant."""
        x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        if len(y) == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = []
            margin += self._grow(tree, binned, edges, p - y, p * (1 - p), np.arange(len(y)), 0)
            self.trees.append(tree)
        return self

    def _grow(self, tree: list, binned, edges, g, h, rows, level) -> np.ndarray:
        """Append this node to ``tree``; the step of every sample, zero for those outside ``rows``."""
        me, step = len(tree), np.zeros(len(g))
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if level < self.depth:
            for j, e in enumerate(edges):
                if len(e):
                    left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], minlength=len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], minlength=len(e) + 1))[:-1]
                    right_g, right_h = total_g - left_g, total_h - left_h
                    gain = left_g**2 / (left_h + self.shrink) + right_g**2 / (right_h + self.shrink) - total_g**2 / (total_h + self.shrink)
                    gain[(left_h < self.least) | (right_h < self.least)] = -1
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), j, at)
        if best[1] is None:
            value = -self.rate * float(total_g / (total_h + self.shrink))
            tree.append(("leaf", value))
            step[rows] = value
            return step
        _, j, at = best
        tree.append(None)
        low = binned[rows, j] <= at
        step += self._grow(tree, binned, edges, g, h, rows[low], level + 1)
        right = len(tree)
        step += self._grow(tree, binned, edges, g, h, rows[~low], level + 1)
        tree[me] = ("split", j, float(edges[j][at]), me + 1, right)
        return step

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self._walk(tree, 0, x, np.arange(len(x)))
        return out

    def _walk(self, tree: list, node: int, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        if tree[node][0] == "leaf":
            out[rows] = tree[node][1]
            return out
        _, j, threshold, left, right = tree[node]
        low = x[rows, j] <= threshold
        for child, some in ((left, rows[low]), (right, rows[~low])):
            if len(some):
                out += self._walk(tree, child, x, some)
        return out

    def sql(self, names: list[str]) -> str:
        """The margin as a SQL expression over columns of these names."""

        def node(tree: list, at: int) -> str:
            if tree[at][0] == "leaf":
                return f"{tree[at][1]!r}D"
            _, j, threshold, left, right = tree[at]
            return f"CASE WHEN `{names[j]}` <= {threshold!r}D THEN {node(tree, left)} ELSE {node(tree, right)} END"

        return " + ".join([f"{self.start!r}D", *(f"({node(t, 0)})" for t in self.trees)])


class Isotonic:
    """The non-decreasing step function nearest to the labels, drawn through its steps' centres."""

    def __init__(self, knots: int = 200):
        self.knots, self.x, self.y = knots, np.array([0.0]), np.array([0.5])

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(y):
            return self
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
        for m, label in zip(margin[order], y[order], strict=True):
            blocks.append([float(label), 1.0, float(m)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        at = np.unique(np.linspace(0, len(blocks) - 1, min(self.knots, len(blocks))).astype(int))
        self.x = np.array([blocks[i][2] / blocks[i][1] for i in at])
        self.y = np.array([(blocks[i][0] + 0.1) / (blocks[i][1] + 0.5) for i in at])
        self.y = np.maximum.accumulate(self.y)
        return self

    def apply(self, margin: np.ndarray) -> np.ndarray:
        """Values in 0 to 1; a thousandth of the plain logistic value keeps the order of equal steps."""
        flat = np.interp(margin, self.x, self.y)
        return np.clip(0.999 * flat + 0.001 / (1 + np.exp(-np.clip(margin, -40, 40))), 0.0, 1.0)
