"""Small dense linear models, fitted on the driver over a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25, intercept: bool = True) -> np.ndarray:
    """Weights (the intercept last, if any) of a ridge-penalised logistic regression, by Newton steps."""
    if intercept:
        x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * max(1, len(x)) / 1000)
    if intercept:
        penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (y - p) - penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        size = np.abs(step).max(initial=0)
        w += step * min(1, 5 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold (score >= it counts as 1) with the best F1; midway between the scores around it."""
    if not len(y) or not y.any():
        return 0.5
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    at = int(np.argmax(f1))
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])
