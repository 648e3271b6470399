"""Isotonic calibration on binned scores."""

from __future__ import annotations

import numpy as np


def pav(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit to the means total / weight of bins in order (pool adjacent violators); bins of weight 0 take a neighbour's value."""
    level: list[list[float]] = []
    for w, t in zip(weight.tolist(), total.tolist(), strict=True):
        level.append([w, t, 1])
        while len(level) > 1 and level[-2][1] * level[-1][0] >= level[-1][1] * level[-2][0]:
            w2, t2, n2 = level.pop()
            level[-1] = [level[-1][0] + w2, level[-1][1] + t2, level[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / w if w else np.nan) for w, t, n in level]) if level else np.zeros(0)


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of the calibration curve for binned scores; y within 0 and 1. Without rows a flat curve at one half."""
    keep = weight > 0
    if not keep.any():
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(score[keep], kind="stable")
    return score[keep][order], np.clip(pav(weight[keep][order], label[keep][order]), 0.0, 1.0)
