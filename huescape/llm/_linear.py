"""Small linear models, fitted on the driver on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


class Sparse:
    """Rows of (column, value) as flat arrays."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.shape[0])

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * g[self.rows], self.shape[1])


def fit_sparse(x: Sparse, y: np.ndarray, pairs: Sparse | None = None, l2: float = 1.0, fairness: float = 0.0, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model, by Adam on all rows: log loss + l2 / 2 |w|^2 + fairness * sum of the
    squared scores of `pairs` (rows of differences of features between a text and its counterfactual)."""
    w, b, n = np.zeros(x.shape[1]), logit(y.mean()) if len(y) else 0.0, max(1, len(y))
    m, v, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), rate
    for t in range(1, rounds + 1):
        g = sigmoid(x.dot(w) + b) - y
        grad = x.t_dot(g) + l2 * w
        if pairs is not None and pairs.shape[0]:
            grad += 2 * fairness * pairs.t_dot(pairs.dot(w))
        grad = np.concatenate([grad, [g.sum()]]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (1 - t / (rounds + 1))
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, intercept, and each column's mean and scale, by Newton steps on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 5 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1]), mean, scale


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    order = np.argsort(score, kind="stable")
    s, rank = score[order], np.arange(1, len(score) + 1, dtype=float)
    _, first, count = np.unique(s, return_index=True, return_counts=True)
    rank = np.repeat(first + (count + 1) / 2, count)
    pos = y[order] == 1
    n1, n0 = int(pos.sum()), int((~pos).sum())
    return float((rank[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")
