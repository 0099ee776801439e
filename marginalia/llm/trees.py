"""Small tree ensembles: fitted on the driver from a bounded labelled sample, applied as SQL text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def sql(self, names: list[str]) -> str:
        if self.left is None or self.right is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {names[self.feature]} <= {self.cut!r}D THEN {self.left.sql(names)} ELSE {self.right.sql(names)} END"

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, least: float, rng: np.random.Generator, features: int | None = None, penalty: float = 1.0) -> Node:
    """A regression tree on second-order statistics: leaves hold sum(gradient) / (sum(weight) + penalty)."""
    g, h = float(gradient.sum()), float(weight.sum())
    node = Node(g / (h + penalty))
    if depth == 0 or h < 2 * least:
        return node
    best = (g * g / (h + penalty) + 1e-9, -1, 0.0)
    for f in sorted(rng.permutation(x.shape[1])[: features or x.shape[1]]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(gradient[order]), np.cumsum(weight[order])
        ok = np.flatnonzero((v[1:] > v[:-1]) & (ch[:-1] >= least) & (h - ch[:-1] >= least))
        if not len(ok):
            continue
        gains = cg[ok] ** 2 / (ch[ok] + penalty) + (g - cg[ok]) ** 2 / (h - ch[ok] + penalty)
        k = int(np.argmax(gains))
        if gains[k] > best[0]:
            best = (float(gains[k]), int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2))
    _, node.feature, node.cut = best
    if node.feature < 0:
        return node
    low = x[:, node.feature] <= node.cut
    node.left = grow(x[low], gradient[low], weight[low], depth - 1, least, rng, features, penalty)
    node.right = grow(x[~low], gradient[~low], weight[~low], depth - 1, least, rng, features, penalty)
    return node


@dataclass
class Boosted:
    """Gradient-boosted trees for a log-odds, then a calibrated probability (Platt: slope, offset)."""

    start: float
    trees: list[Node]
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(t.predict(x) for t in self.trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.offset)))

    def sql(self, names: list[str]) -> str:
        total = " + ".join([f"{self.start!r}D", *[t.sql(names) for t in self.trees]])
        return f"1D / (1D + exp(-({self.slope!r}D * ({total}) + {self.offset!r}D)))"


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 40, depth: int = 3, rate: float = 0.2, least: float = 2.0, seed: int = 0) -> Boosted:
    """Fit on two thirds of the rows, calibrate on the last third."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    fit, held = order[: 2 * len(y) // 3], order[2 * len(y) // 3 :]
    start = float(np.log((y[fit].sum() + 1) / (len(fit) - y[fit].sum() + 1)))
    made = Boosted(start, [])
    margin = np.full(len(fit), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(x[fit], y[fit] - p, p * (1 - p), depth, least, rng)
        _scale(tree, rate)
        margin += tree.predict(x[fit])
        made.trees.append(tree)
    raw = made.margin(x[held])
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic regression of the label on the margin, weakly held to (1, 0)
        p = 1 / (1 + np.exp(-(a * raw + b)))
        grad = np.array([((y[held] - p) * raw).sum() + (1 - a), (y[held] - p).sum() - b])
        w = p * (1 - p)
        hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-10:
            break
    made.slope, made.offset = a, b
    return made


def _scale(node: Node, rate: float) -> None:
    node.value *= rate
    for child in (node.left, node.right):
        if child is not None:
            _scale(child, rate)


@dataclass
class Forest:
    trees: list[Node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum(t.predict(x) for t in self.trees) / len(self.trees)

    def sql(self, names: list[str]) -> str:
        return f"({' + '.join(t.sql(names) for t in self.trees)}) / {len(self.trees)}D"


def forest(x: np.ndarray, y: np.ndarray, *, size: int = 24, depth: int = 6, least: float = 3.0, seed: int = 0) -> Forest:
    """Bootstrap rows, the square root of the features at each split, mean of the leaves' shares.

    For labels 0 and 1 the gain of squared error is the gain of Gini impurity.
    """
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(size):
        rows = rng.integers(0, len(y), len(y))
        made.append(grow(x[rows], y[rows].astype(float), np.ones(len(rows)), depth, least, rng, max(1, round(x.shape[1] ** 0.5)), penalty=0.0))
    return Forest(made)
