"""The best one-to-one matching of a small graph."""

from collections.abc import Iterable

import numpy as np


def _least_cost(cost: np.ndarray) -> list[int]:
    """The column of each row (rows <= columns) at least total cost: shortest augmenting paths with potentials."""
    n, m = cost.shape
    kind = cost.dtype
    zero = 0 if kind == object else 0.0
    top = (int(np.abs(cost).max()) + 1) * (4 * (n + m)) if kind == object else np.inf
    u, v = np.full(n + 1, zero, dtype=kind), np.full(m + 1, zero, dtype=kind)
    match = np.zeros(m + 1, dtype=np.int64)  # row of each column, from 1; 0 is none
    for row in range(1, n + 1):
        match[0], at = row, 0
        least, way = np.full(m + 1, top, dtype=kind), np.zeros(m + 1, dtype=np.int64)
        used = np.zeros(m + 1, dtype=bool)
        while match[at]:
            used[at] = True
            r = match[at]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[r - 1, free - 1] - u[r] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], at
            nearest = int(free[np.argmin(least[free])])
            step = least[nearest]
            u[match[used]] += step
            v[used] -= step
            least[free] -= step
            at = nearest
        while at:
            match[at], at = match[way[at]], way[at]
    out = [0] * n
    for column in range(1, m + 1):
        if match[column]:
            out[match[column] - 1] = column - 1
    return out


def _components(pairs: list[tuple]) -> list[list[tuple]]:
    """Pairs by connected component of their graph."""
    root: dict = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, _ in pairs:
        root[top(("l", a))] = top(("r", b))
    found: dict = {}
    for p in pairs:
        found.setdefault(top(("l", p[0])), []).append(p)
    return list(found.values())


def _whole(gain) -> int | float:
    """Tuples of gains, the first counting most, as whole numbers in steps of a billionth; plain gains as they are."""
    if not isinstance(gain, tuple):
        return float(gain)
    out = 0
    for x in gain:
        out = (out << 80) + round(x * 10**9)
    return out


def assign(pairs: Iterable[tuple]) -> list[tuple]:
    """The most pairs (a, b, gain) without a shared end and, of those, the largest sum of gains, in order.

    A gain may be a tuple: its first part counts most, then the second, and so on. Each connected
    component is matched on its own.
    """
    gain = {(a, b): g for a, b, g in pairs}
    out = []
    for some in _components([(a, b, g) for (a, b), g in gain.items()]):
        if len(some) == 1:
            out.append(some[0])
            continue
        lefts, rights = sorted({a for a, _, _ in some}), sorted({b for _, b, _ in some})
        values = {(a, b): _whole(g) for a, b, g in some}
        exact = any(isinstance(x, int) for x in values.values())
        large = sum(abs(x) for x in values.values()) + 1  # no sum of gains makes up for a pair less
        cost = np.full((len(lefts), len(rights)), large, dtype=object if exact else float)
        row, column = ({x: i for i, x in enumerate(c)} for c in (lefts, rights))
        for (a, b), x in values.items():
            cost[row[a], column[b]] = -x
        turned = len(lefts) > len(rights)
        for i, j in enumerate(_least_cost(cost.T if turned else cost)):
            a, b = (lefts[j], rights[i]) if turned else (lefts[i], rights[j])
            if (a, b) in gain:
                out.append((a, b, gain[a, b]))
    return sorted(out)
