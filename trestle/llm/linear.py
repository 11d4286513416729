"""Logistic regression in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 300, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and intercept for targets in [0, 1], by Adam over all rows; ``penalty`` is on the sum of squares."""
    n, d = x.shape
    w, b = np.zeros(d), 0.0
    if not n:
        return w, b
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    b = float(np.log(p / (1 - p)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        error = sigmoid(x @ w.astype(x.dtype) + b) - y
        g = np.append(x.T @ error.astype(x.dtype) + penalty * w, error.sum()) / n
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:d]
        b -= float(step[d])
    return w, b
