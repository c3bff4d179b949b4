"""One sequence at a time, in order of its frames: tracks, drift, smoothing, events."""

from dataclasses import dataclass, field

import numpy as np

from loopsight.kernels.matching import assign

#: Fixed values of the tracker: rows it predicts from, weights and cap of likeness, shares of the gate.
HISTORY, AREA_WEIGHT, SIGNAL_WEIGHT, RATIO_CAP, COST_SHARE, SIGMA, SIGMA_SHARE = 4, 0.5, 0.25, np.log(4.0), 0.15, 1.0, 0.5


def median_slope(t: np.ndarray, y: np.ndarray) -> float | None:
    """The median slope of all pairs of points at different times; None without any."""
    i, j = np.triu_indices(len(t), 1)
    dt = t[j] - t[i]
    ok = dt != 0
    return float(np.median((y[j] - y[i])[ok] / dt[ok])) if ok.any() else None


@dataclass
class Tracker:
    """Links detections of frames in order to tracks: the most links within the gate, of these the nearest by prediction and likeness.

    A track is predicted by the robust line through its last rows, or by its last place and a prior
    velocity; distances count in the spread of its rows about that line. Its state is small: the
    last rows of the tracks that are still alive.
    """

    gate: float
    max_gap: float = 1.0
    prior_y: float = 0.0
    prior_x: float = 0.0
    alive: dict[int, list[tuple]] = field(default_factory=dict)
    made: int = 0

    def line(self, rows: list[tuple], axis: int) -> tuple[float, float] | None:
        t, v = np.array([r[0] for r in rows]), np.array([r[axis] for r in rows])
        slope = median_slope(t, v)
        return None if slope is None else (slope, float(np.median(v - slope * t)))

    def sigma(self, rows: list[tuple], axis: int, gap: float) -> float:
        fitted = self.line(rows, axis) if len(rows) >= 3 else None
        s = SIGMA
        if fitted:
            off = [abs(r[axis] - fitted[0] * r[0] - fitted[1]) for r in rows]
            s = float(np.percentile(off, 75))
        return min(max(s * gap, SIGMA), max(SIGMA, self.gate * SIGMA_SHARE))

    def predicted(self, rows: list[tuple], frame: float) -> tuple[float, float]:
        y, x = (self.line(rows, a) if len(rows) >= 2 else None for a in (1, 2))
        if y and x:
            return y[1] + y[0] * frame, x[1] + x[0] * frame
        gap = frame - rows[-1][0]
        return rows[-1][1] + self.prior_y * gap, rows[-1][2] + self.prior_x * gap

    @staticmethod
    def unlike(a: float | None, b: float | None) -> float | None:
        return min(abs(float(np.log(a / b))), RATIO_CAP) if a and b and a > 0 and b > 0 else None

    def step(self, frame: float, found: list[tuple]) -> list[int]:
        """Track numbers of a frame's detections (y, x, area or None, signal or None)."""
        self.alive = {i: rows for i, rows in self.alive.items() if frame - rows[-1][0] <= self.max_gap}
        cap = self.gate * COST_SHARE
        pairs = []
        for i, rows in self.alive.items():
            if frame <= rows[-1][0]:
                continue
            y, x = self.predicted(rows, frame)
            gap = max(1.0, frame - rows[-1][0])
            sy, sx = self.sigma(rows, 1, gap), self.sigma(rows, 2, gap)
            area, signal = (float(np.median(v)) if (v := [r[k] for r in rows if r[k]]) else None for k in (3, 4))
            for j, d in enumerate(found):
                if np.hypot(d[0] - y, d[1] - x) > self.gate:
                    continue
                cost = sum(w * u for w, u in ((AREA_WEIGHT, self.unlike(area, d[2])), (SIGNAL_WEIGHT, self.unlike(signal, d[3]))) if u is not None)
                # a place is measured to one pixel
                far = np.sqrt((d[0] - y) ** 2 / (sy * sy + 1) + (d[1] - x) ** 2 / (sx * sx + 1))
                pairs.append((i, j, -float(far + min(cost, cap))))
        taken = {j: i for i, j, _ in assign(pairs)}
        out = []
        for j, d in enumerate(found):
            number = taken.get(j)
            if number is None:
                number, self.made = self.made, self.made + 1
            self.alive[number] = [*self.alive.get(number, []), (float(frame), *map(_number, d))][-HISTORY:]
            out.append(number)
        return out


def _number(x) -> float | None:
    return None if x is None or not np.isfinite(x) else float(x)


@dataclass
class DriftFilter:
    """Follows the corrections of accepted registrations: an exponential mean of where they point."""

    alpha: float = 0.15
    min_score: float = 0.05
    max_step: float | None = None
    max_drift: float | None = None
    drift: float = 0.0

    def step(self, correction: float | None, score: float | None) -> tuple[float, bool]:
        """(drift before the frame, whether the frame was accepted); a missing score is 0."""
        before = self.drift
        s = 0.0 if score is None else score
        ok = np.isfinite(s) and s >= self.min_score and correction is not None and np.isfinite(correction)
        if ok and (self.max_step is None or abs(correction) <= self.max_step):
            to = before + correction
            if self.max_drift is not None:
                to = min(max(to, -self.max_drift), self.max_drift)
            self.drift = (1 - self.alpha) * before + self.alpha * to
            return before, True
        return before, False


def kalman(phases: np.ndarray, period: float, scores: np.ndarray | None = None, process: float = 0.1, measured: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(phase, velocity) after each measured phase, by a filter of constant velocity; low scores count less (a twentieth at least)."""
    z = np.unwrap(phases, period=period)
    weight = np.ones(len(z)) if scores is None else np.clip(np.nan_to_num(scores, nan=0.0), 0.05, 1.0)
    out_p, out_v = np.empty(len(z)), np.empty(len(z))
    p = v = 0.0
    a = c = measured**2
    b = 0.0  # the covariance [[a, b], [b, c]]
    for i, m in enumerate(z):
        if i:  # phase falls by the velocity
            p, a, b, c = p - v, a - 2 * b + c + process**2, b - c, c + process**2
        else:
            p = m
        spread = a + (measured / weight[i]) ** 2
        gain, turn = a / spread, b / spread
        off = m - p
        p, v = p + gain * off, v + turn * off
        a, b, c = (1 - gain) * a, (1 - gain) * b, c - turn * b
        out_p[i], out_v[i] = p % period, v
    return out_p, out_v


def _typical(x: np.ndarray, sigma: float) -> np.ndarray:
    """Which values lie within sigma robust scales of their median; all where half of them are equal."""
    off = np.abs(x - np.median(x))
    scale = 1.4826 * float(np.median(off))
    return off <= sigma * scale if scale > 1e-12 else np.ones(len(x), dtype=bool)


def _local_line(t: np.ndarray, y: np.ndarray, w: np.ndarray, at: float) -> float:
    """The weighted least-squares line at a place; the weighted mean where all times are equal."""
    m = np.average(t, weights=w)
    s = (w * (t - m) ** 2).sum()
    mean = np.average(y, weights=w)
    return float(mean if s <= 1e-12 else mean + (w * (t - m) * (y - mean)).sum() / s * (at - m))


def smoothed(frames: np.ndarray, corrections: np.ndarray, scores: np.ndarray, radius: float, period: float | None = None, support: int = 3,
             sigma: float = 3.0, min_score: float | None = None, most: float | None = None) -> np.ndarray:
    """Corrections by a local line through those within radius frames, near ones counting more; outliers are left out.

    Where fewer than support are near, the nearest ones are taken. With a period corrections are
    brought next to each other first. NaN where there's nothing to go by.
    """
    ok = np.isfinite(frames) & np.isfinite(corrections)
    if min_score is not None:
        ok &= np.isfinite(scores) & (scores >= min_score)
    if most is not None:
        ok &= np.abs(corrections) <= most
    known = np.flatnonzero(ok)
    weight = np.where(np.isfinite(scores), np.maximum(scores, 1e-6), 1.0)
    out = np.full(len(frames), np.nan)
    for i, at in enumerate(frames):
        near = known[np.abs(frames[known] - at) <= radius]
        need = min(support, len(known))
        if len(near) < need:
            near = known[np.argsort(np.abs(frames[known] - at), kind="stable")[:need]]
        if not len(near):
            continue
        t, y = frames[near], corrections[near]
        w = weight[near] * np.maximum(1e-6, 1 - np.abs(t - at) / (radius + 1))
        if period:
            turn = 2 * np.pi / period
            middle = np.angle((w * np.exp(1j * turn * y)).sum()) / turn
            y = middle + (y - middle + period / 2) % period - period / 2
        # first what is far from the median goes, then what is far from the line of the rest
        good = _typical(y, sigma)
        if good.sum() >= need:
            t, y, w = t[good], y[good], w[good]
        if len(t) >= max(3, need):
            good = _typical(y - np.array([_local_line(t, y, w, x) for x in t]), sigma)
            if good.sum() >= need:
                t, y, w = t[good], y[good], w[good]
        value = _local_line(t, y, w, at)
        out[i] = (value + period / 2) % period - period / 2 if period else value
    return out


def linked(frames: list[float], places: list[tuple[float, float]], gap: float, far: float) -> list[int]:
    """Numbers of short tracks: each detection in turn joins the nearest track end within reach, else begins one."""
    ends: dict[int, tuple] = {}
    out = []
    for t, (y, x) in zip(frames, places, strict=True):
        best = None
        for n, (u, b, a) in ends.items():
            d = float(np.hypot(y - b, x - a))
            if 0 < t - u <= gap and d <= far and (best is None or (d, n) < best):
                best = (d, n)
        n = best[1] if best else len(set(out))
        ends[n] = (t, y, x)
        out.append(n)
    return out


def events_of_boxes(boxes: list[tuple], least: float, gap: float) -> list[int]:
    """Event numbers of boxes (frame, top, left, bottom, right, id or None) in order of frames.

    Boxes of an id are one event; others join the event whose last box overlaps most, at least by that
    IoU and within gap frames, else begin one.
    """
    named: dict = {}
    last: dict[int, tuple] = {}
    out, n = [], 0
    for frame, *box, key in boxes:
        number = named.get(key) if key is not None else None
        if key is None:
            best = None
            for e, (u, other) in last.items():
                if 0 < frame - u <= gap:
                    both = max(0, min(box[2], other[2]) - max(box[0], other[0])) * max(0, min(box[3], other[3]) - max(box[1], other[1]))
                    union = (box[2] - box[0]) * (box[3] - box[1]) + (other[2] - other[0]) * (other[3] - other[1]) - both
                    iou = both / union if union > 0 else 0.0
                    if iou >= least and (best is None or iou > best[0]):
                        best = (iou, e)
            number = best[1] if best else None
        if number is None:
            number, n = n, n + 1
            if key is not None:
                named[key] = number
        if key is None:
            last[number] = (frame, box)
        out.append(number)
    return out
