"""Radial distortion by the division model, in half diagonals of the picture."""

from __future__ import annotations

import numpy as np

#: Coefficients that are looked at, points a line needs, share of the bend that must go.
RANGE, LEAST_POINTS, LEAST_GAIN = (-0.6, 0.6), 30, 0.2


def straightened(points: np.ndarray, k: float | np.ndarray, width: float, height: float) -> np.ndarray:
    """Points of the picture as a pinhole camera would see them; several ``k`` give as many sets."""
    c, r = np.array([width / 2, height / 2]), np.hypot(width, height) / 2
    d = points - c
    return c + d / (1 + np.multiply.outer(k, (d * d).sum(axis=-1) / (r * r)))[..., None]


def bent(points: np.ndarray, k: float, width: float, height: float, rounds: int = 8) -> np.ndarray:
    """Inverse of ``straightened``, by fixed-point steps."""
    c, r = np.array([width / 2, height / 2]), np.hypot(width, height) / 2
    d = want = points - c
    for _ in range(rounds):
        d = want * (1 + k * (d * d).sum(axis=-1) / (r * r))[..., None]
    return c + d


def bend(points: np.ndarray) -> np.ndarray:
    """Mean square distance of points from their best line, for each set."""
    d = points - points.mean(axis=-2, keepdims=True)
    return np.linalg.eigvalsh(np.swapaxes(d, -1, -2) @ d)[..., 0].clip(0) / points.shape[-2]


def residual(lines: list[np.ndarray], k: np.ndarray, width: float, height: float) -> np.ndarray:
    """Mean square distance of all points from the lines they should be on, for each ``k``."""
    w = np.array([len(line) for line in lines], float)
    return np.stack([bend(straightened(line, k, width, height)) for line in lines], axis=-1) @ w / w.sum()


def coefficient(lines: list[np.ndarray], width: float, height: float, rounds: int = 12, steps: int = 13) -> tuple[float, float, float, int] | None:
    """(k, gain, pixels off, lines) of the coefficient that makes lines straightest; None where it changes too little or too few points are seen.

    The range is sampled evenly, then again around the best, each time a third as wide.
    """
    usable = [line for line in (np.asarray(v, float).reshape(-1, 2) for v in lines) if len(line) >= LEAST_POINTS]
    if not usable:
        return None
    lo, hi = RANGE
    for _ in range(rounds):
        ks = np.linspace(lo, hi, steps)
        best = ks[int(residual(usable, ks, width, height).argmin())]
        lo, hi = max(RANGE[0], best - (hi - lo) / 6), min(RANGE[1], best + (hi - lo) / 6)
    before, after = residual(usable, np.array([0.0, best]), width, height)
    if before <= 1e-9 or 1 - after / before < LEAST_GAIN:
        return None
    return round(float(best), 4), round(float(1 - after / before), 3), round(float(np.sqrt(after)), 2), len(usable)
