"""Local regression of one curve: direct fits at the vertices of a k-d tree, blended between them."""

from __future__ import annotations

import numpy as np


def vertices(n: int, most: int) -> list[int]:
    """Places among n sorted points: both ends, and the medians at which cells are cut until none has more than `most` points."""
    cuts, cells = {0, n - 1}, [(0, n - 1)]
    while cells:
        lo, hi = cells.pop()
        if hi - lo > max(1, most):
            mid = (lo + hi) // 2
            cuts.add(mid)
            cells += [(lo, mid), (mid, hi)]
    return sorted(cuts)


def local_fit(x: np.ndarray, y: np.ndarray, at: float, near: int, degree: int) -> tuple[float, float]:
    """Value and slope at a place of the polynomial fitted to the `near` nearest of the sorted points x, weighted by the tricube of their distance."""
    lo = int(np.clip(np.searchsorted(x, at) - near, 0, len(x) - near))
    while lo + near < len(x) and x[lo + near] - at < at - x[lo]:
        lo += 1
    d = x[lo : lo + near] - at
    far = np.abs(d).max() or 1.0
    u = d / far
    w = np.sqrt(np.clip(1 - (np.abs(u) / 1.001) ** 3, 0, None) ** 3)  # the furthest keeps a little weight
    basis = np.vander(u, min(degree, len(np.unique(d)) - 1) + 1, increasing=True)
    fit = np.linalg.lstsq(basis * w[:, None], y[lo : lo + near] * w, rcond=None)[0]
    return float(fit[0]), float(fit[1] / far) if len(fit) > 1 else 0.0


def curve(x: np.ndarray, y: np.ndarray, span: float, degree: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """`points` places over the range of the sorted, distinct x, and the smooth curve there; fewer than two points give themselves."""
    n = len(x)
    if n < 2:
        return x, y
    near = min(n, max(degree + 2, int(span * n)))
    at = x[vertices(n, int(0.2 * near))]
    value, slope = np.array([local_fit(x, y, v, near, degree) for v in at]).T
    grid = np.linspace(x[0], x[-1], points)
    i = np.clip(np.searchsorted(at, grid, "right") - 1, 0, len(at) - 2)
    h = at[i + 1] - at[i]
    t = (grid - at[i]) / h
    # the cubic of both values and slopes
    a, b = value[i + 1] - value[i], slope[i] * h
    c = slope[i + 1] * h
    return grid, value[i] + t * (b + t * (3 * a - 2 * b - c + t * (b + c - 2 * a)))
