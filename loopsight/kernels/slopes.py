"""Medians of the slopes between points, with memory in proportion to the points."""

import numpy as np

#: Points up to which all slopes are made at once.
DIRECT = 1500


def _inversions(z: np.ndarray) -> int:
    """How many pairs of z stand in falling order."""
    n, width, total = len(z), 1, 0
    z = z.copy()
    while width < n:
        for at in range(0, n - width, 2 * width):
            left, right = z[at : at + width], z[at + width : at + 2 * width]
            total += int(len(left) * len(right) - np.searchsorted(left, right, side="right").sum())
            z[at : at + 2 * width] = np.sort(z[at : at + 2 * width], kind="stable")
        width *= 2
    return total


def _below(t: np.ndarray, y: np.ndarray, slope: float) -> int:
    """Pairs of points at different times with a slope below one given; points are sorted by time."""
    z = y - slope * t
    return _inversions(z[np.lexsort((z, t))])  # points of one time in rising order, so that they don't count


def median_slope(t: np.ndarray, y: np.ndarray) -> tuple[float | None, int]:
    """(median, number) of the slopes of all pairs of points at different times; (None, 0) without any.

    Of many points the slopes aren't made: how many lie below a slope is counted by sorting, and the
    middle ones are closed in on to the last digits of a double.
    """
    order = np.argsort(t, kind="stable")
    t, y = np.asarray(t, dtype=float)[order], np.asarray(y, dtype=float)[order]
    n = len(t)
    same = np.unique(t, return_counts=True)[1]
    pairs = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return None, 0
    if n <= DIRECT:
        i, j = np.triu_indices(n, 1)
        dt = t[j] - t[i]
        ok = dt != 0
        return float(np.median((y[j] - y[i])[ok] / dt[ok])), pairs
    steps = np.diff(np.unique(t)).min()
    most = (y.max() - y.min()) / steps + 1.0

    def nth(k: int) -> float:
        """The k-th smallest slope, from 0."""
        low, high = -most, most
        for _ in range(200):
            middle = (low + high) / 2
            if not low < middle < high:
                break
            low, high = (middle, high) if _below(t, y, middle) <= k else (low, middle)
        return low

    return float(nth((pairs - 1) // 2) + nth(pairs // 2)) / 2, pairs


def repeated_median(t: np.ndarray, y: np.ndarray) -> float | None:
    """The median over distinct points of the median slope through each; a row of slopes is held at a time."""
    t, y = np.asarray(t, dtype=float), np.asarray(y, dtype=float)
    out = []
    for a, b in np.unique(np.c_[t, y], axis=0):
        ok = t != a
        if ok.any():
            out.append(np.median((y[ok] - b) / (t[ok] - a)))
    return float(np.median(out)) if out else None
