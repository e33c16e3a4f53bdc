"""Gradient-boosted trees for two classes: fitted in numpy on a bounded sample, applied as a Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, rate: float) -> Node:
    node = Node(value=rate * float(g.sum() / (h.sum() + 1.0)))
    if depth == 0 or len(x) < 2 * least:
        return node
    best = 1e-6
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="nearest"))
        for cut in cuts:
            low = x[:, f] <= cut
            n = int(low.sum())
            if n < least or len(x) - n < least:
                continue
            gl, hl = g[low].sum(), h[low].sum()
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
            if gain > best:
                best, node.feature, node.cut = gain, f, float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low = _grow(x[low], g[low], h[low], depth - 1, least, rate)
        node.high = _grow(x[~low], g[~low], h[~low], depth - 1, least, rate)
    return node


@dataclass
class Boosted:
    """Trees over named features; the sum of their leaves is the log odds."""

    names: list[str]
    start: float
    trees: list[Node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += np.array([_leaf(tree, row) for row in x])
        return out

    def splits(self) -> dict[str, int]:
        """How many splits each feature decides."""
        out = dict.fromkeys(self.names, 0)
        rest = list(self.trees)
        while rest:
            node = rest.pop()
            if node.low is not None and node.high is not None:
                out[self.names[node.feature]] += 1
                rest += [node.low, node.high]
        return out

    def sql(self) -> str:
        """The log odds as SQL over the feature columns, so that scoring stays in generated code."""
        return " + ".join([repr(self.start), *(_sql(t, self.names) for t in self.trees)])


def _leaf(node: Node, row: np.ndarray) -> float:
    while node.low is not None and node.high is not None:
        node = node.low if row[node.feature] <= node.cut else node.high
    return node.value


def _sql(node: Node, names: list[str]) -> str:
    if node.low is None or node.high is None:
        return f"{node.value:.9g}D"
    return f"if({names[node.feature]} <= {node.cut!r}D, {_sql(node.low, names)}, {_sql(node.high, names)})"


def boost(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 20, depth: int = 3, rate: float = 0.4, least: int = 8) -> Boosted:
    """Fit on rows ``x`` with classes ``y`` (0 or 1) by Newton steps on the logistic loss."""
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Boosted(names, float(np.log(base / (1 - base))), [])
    score = np.full(len(y), model.start)
    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), depth, least, rate)
        score += np.array([_leaf(tree, row) for row in x])
        model.trees.append(tree)
        if tree.feature < 0:
            break
    return model
