"""Probability calibration of a classifier's scores."""

from __future__ import annotations

import numpy as np


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and shift of the logistic curve through scores z of rows held out, on smoothed targets, by Newton's method.

    Scores that contradict the labels give slope 1 and shift 0: the uncalibrated score is then the better guess.
    """
    ones, zeros = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, [((p - target) * z).sum(), (p - target).sum()])
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        slope, shift = slope - step[0], shift - step[1]
    return (float(slope), float(shift)) if slope > 0 else (1.0, 0.0)
