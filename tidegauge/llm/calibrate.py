"""Isotonic calibration of a score on at most a few thousand weighted points."""

from __future__ import annotations

import numpy as np


def isotonic(scores: np.ndarray, weights: np.ndarray, positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability), rising in both, by pooling adjacent violators; each pool is smoothed by half a row of either label."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # weight, positives, weighted score
    for s, w, p in zip(scores[order], weights[order], positives[order]):
        pools.append([w, p, w * s])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    if not pools:
        return np.array([0.0]), np.array([0.5])
    x = np.array([s / w for w, _, s in pools])
    y = np.maximum.accumulate(np.array([(p + 0.5) / (w + 1.0) for w, p, _ in pools]))
    return x, y


def apply(knots: tuple[np.ndarray, np.ndarray], scores: np.ndarray) -> np.ndarray:
    """Calibrated probabilities; a thousandth of a smooth curve keeps equal probabilities in the order of their scores."""
    x, y = knots
    slope = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    return 0.999 * np.interp(scores, x, y) + 0.001 * slope
