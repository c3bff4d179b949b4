import itertools

import numpy as np
import pytest

from loopsight.kernels import images, sequences
from loopsight.kernels.matching import assign

draw = np.random.default_rng(7)


def test_box_sums_and_means():
    x = draw.random((7, 9))
    for r in (0, 1, 3):
        sums, means, padded = images.box_sums(x, r), images.box_means(x, r), np.pad(x, r, mode="edge")
        for y, c in itertools.product(range(7), range(9)):
            assert sums[y, c] == pytest.approx(x[max(0, y - r) : y + r + 1, max(0, c - r) : c + r + 1].sum())
            assert means[y, c] == pytest.approx(padded[y : y + 2 * r + 1, c : c + 2 * r + 1].mean())


def flood(mask, connectivity):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in itertools.product(*map(range, mask.shape)):
        if mask[y, x] and not out[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (connectivity == 8 or not (i and j))]
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_are_those_of_a_flood_fill(connectivity):
    for share in (0.2, 0.45, 0.6, 0.8):
        for _ in range(15):
            mask = draw.random((13, 17)) < share
            assert (images.labelled(mask, connectivity) == flood(mask, connectivity)).all()
    assert images.labelled(np.zeros((3, 3), bool)).max() == 0


def test_detections_hold_what_lies_in_them():
    signal = draw.normal(size=(20, 30))
    mask = signal > 1
    parts = flood(mask, 8)
    found = images.components(mask, signal, images.Gates(min_area=2))
    for d in found:
        r, c = np.nonzero(parts == d["label"])
        w = signal[r, c]
        assert d["area_px"] == len(r) >= 2 and d["peak_signal"] == w.max() and d["mean_signal"] == pytest.approx(w.mean())
        assert (d["y"], d["x"]) == pytest.approx(((r * w).sum() / w.sum(), (c * w).sum() / w.sum()))
        assert (d["bbox_top"], d["bbox_left"], d["bbox_bottom"], d["bbox_right"]) == (r.min(), c.min(), r.max() + 1, c.max() + 1)
    assert len(found) == sum((parts == i).sum() >= 2 for i in range(1, parts.max() + 1))
    wide = np.zeros((6, 12), bool)
    wide[1:5, 1:4] = wide[1:5, 8:11] = True
    wide[2, 4:8] = True
    assert len(images.components(wide)) == 1
    split = images.components(wide, gates=images.Gates(split=True, split_gap=2))
    assert [(d["bbox_left"], d["bbox_right"]) for d in split] in ([(8, 11), (1, 4)], [(1, 4), (8, 11)])


def test_hysteresis_keeps_what_touches_a_seed():
    x = np.array([[0, 3, 6, 3, 0, 3, 3, 0]], float)
    assert images.detected(x, 5, 2).tolist() == [[False, True, True, True, False, False, False, False]]
    assert images.detected(x, 5).sum() == 1
    x[0, 1] = np.nan
    assert images.detected(x, 5, 2).sum() == 2
    assert images.detected(-x, 5, mode="negative").sum() == 1 and images.mode_of("Bright") == "positive"


def test_local_noise_and_residual():
    noise = draw.normal(scale=3, size=(80, 80))
    image = noise.copy()
    image[40:44, 40:44] += 100
    raw, local, normal = images.residual(image, np.zeros_like(image))
    assert (raw == image).all() and np.allclose(normal, raw / local)
    assert local[40, 40] == pytest.approx(3, abs=0.5)  # the particle isn't noise
    valid = np.ones_like(image, bool)
    valid[:10] = False
    assert np.isnan(images.residual(image, np.zeros_like(image), valid)[2][:10]).all()


def test_registration_finds_the_phase():
    surface = images.box_means(draw.normal(size=(60, 24)), 1) * 100
    for true in (7.0, 33.5, 58.25):
        frame = images.rendered(surface, true, 30) + draw.normal(scale=0.2, size=(30, 24))
        frame[3:8, 3:8] += 500  # a particle
        got = images.register(frame, surface, (true + 2.25) % 60, 60.0, radius=4, step=0.25, highpass=6)
        assert abs((got["phase_px"] - true + 30) % 60 - 30) <= 0.25 and 0 <= got["score"] <= 1
        finer = images.register(frame, surface, (true + 2.1) % 60, 60.0, radius=4, step=0.5, highpass=6, subpixel=True, robust=True)
        assert abs((finer["phase_px"] - true + 30) % 60 - 30) < 0.15
    assert images.register(np.full((4, 24), np.nan), surface, 0.0, 60.0)["score"] is None


def test_shifts_and_photometry():
    a = images.box_means(draw.normal(size=(40, 20)), 1)
    moved = np.roll(a, 3, axis=0)
    assert images.vertical_shift(a, moved, 6) == pytest.approx(3, abs=0.3)
    dy, dx, loss, _ = images.xy_shift(np.roll(np.roll(a, 2, 0), -1, 1), a, 3, 3)
    assert (dy, dx) == (2, -1) and loss < 1e-12
    image = 1.25 * a + 4 + draw.normal(scale=0.01, size=a.shape)
    image[:2] += 50
    gain, offset, n, rmse, trimmed = images.gain_offset(image, a, trim=0.1, rounds=6)
    assert (gain, offset) == pytest.approx((1.25, 4), abs=0.05) and n < a.size and trimmed == pytest.approx(1 - n / a.size)
    assert images.gain_offset(image, a, least=10_000) is None
    assert images.sub_minimum(np.array([2.0, 0.0, 1.0]), np.array([1.25, 2.25, 0.25])) == pytest.approx(7 / 6)


def test_homography_and_warp():
    source = np.array([[0, 0], [10, 0], [10, 8], [0, 8], [5, 4]], float)
    h = np.array([[1.1, 0.1, 2], [0.05, 0.9, 1], [0.001, 0.002, 1]])
    p = np.c_[source, np.ones(5)] @ h.T
    assert np.allclose(images.homography(source, p[:, :2] / p[:, 2:]), h)
    image = draw.random((6, 7))
    assert np.allclose(images.warped(image, np.eye(3), 6, 7), image)
    shifted = images.warped(image, np.array([[1, 0, 2], [0, 1, 1], [0, 0, 1]], float), 6, 7, fill=-1)
    assert np.allclose(shifted[1:, 2:], image[:-1, :-2]) and (shifted[0] == -1).all()


def test_moments_masks_and_measures():
    y, x = np.mgrid[:40, :60]
    ellipse = ((y - 20) / 6) ** 2 + ((x - 30) / 15) ** 2 <= 1
    m = images.moments(ellipse)
    assert (m["y"], m["x"], m["major"], m["minor"]) == pytest.approx((20, 30, 30, 12), rel=0.03) and abs(m["orientation"]) < 0.01
    found = images.map_mask(np.where(ellipse, 9.0, 0.0), "positive", 5, dilation=1, margin=2, min_area=10)
    assert found[12:29, 13:48].all() and not found[:11].any()
    assert images.map_mask(np.where(ellipse, 9.0, 0.0), "positive", 5, min_area=10_000).sum() == 0
    q = images.quality(np.arange(100.0).reshape(10, 10))
    assert q["p50"] == 49.5 and q["laplacian_variance"] == 0 and images.texture(np.ones((4, 4)))["mad"] == 0
    still = np.zeros((5, 20, 20))
    still[:, 5:9, 6:12] = draw.random((5, 4, 6))
    assert images.moving_region(still, 90, 1) == (4, 5, 6, 8)
    assert (images.randomized(np.ones((5, 5)), 3) == images.randomized(np.ones((5, 5)), 3)).all()
    assert images.colour_score(np.zeros((3, 3, 3)), np.zeros((3, 3, 3))).max() == 0
    assert images.split_at_gaps(np.array([[1, 1, 1, 1]], bool), 100).max() == 1


def test_lexicographic_assignment():
    for _ in range(100):
        pairs = [(a, b, (round(draw.random(), 1), round(draw.random(), 1))) for a in range(4) for b in range(4) if draw.random() < 0.6]
        sets = [c for n in range(5) for c in itertools.combinations(pairs, n) if len({p[0] for p in c}) == len({p[1] for p in c}) == n]
        best = max((len(c), round(sum(p[2][0] for p in c), 6), round(sum(p[2][1] for p in c), 6)) for c in sets)
        got = assign(pairs)
        assert (len(got), round(sum(p[2][0] for p in got), 6), round(sum(p[2][1] for p in got), 6)) == best
    many = [(a, b, float(draw.random())) for a in range(120) for b in range(150)]
    assert len(assign(many)) == 120


def test_tracker_follows_crossing_particles_and_gaps():
    t = sequences.Tracker(gate=6.0, max_gap=2, prior_y=2.0)
    seen = []
    for f in range(12):
        found = [(2.0 * f, 1.0 * f, 9.0, 5.0), (22.0 - 2.0 * f, 10.0, 40.0, 20.0)]
        found = found[:1] if f == 5 else found
        seen.append(t.step(f, found))
    assert all(s == [0, 1] for i, s in enumerate(seen) if i != 5) and seen[5] == [0]
    assert t.step(20, [(0.0, 0.0, None, None)]) == [2] and set(t.alive) == {2}


def test_drift_filter_and_kalman():
    f = sequences.DriftFilter(alpha=0.5, min_score=0.2, max_step=3.0, max_drift=2.0)
    assert [f.step(2.0, 1.0), f.step(2.0, 0.1), f.step(9.0, 1.0), f.step(None, 1.0)] == [(0.0, True), (1.0, False), (1.0, False), (1.0, False)]
    assert f.step(3.0, 1.0) == (1.0, True) and f.drift == 1.5  # the goal is cut at 2
    period, v = 100.0, 3.0
    true = (50 - v * np.arange(60)) % period
    p, u = sequences.kalman((true + draw.normal(scale=0.3, size=60)) % period, period, np.full(60, 0.9))
    assert abs(u[-10:].mean() - v) < 0.1 and np.abs((p[-10:] - true[-10:] + 50) % period - 50).max() < 1


def test_smoothing_goes_around_the_turn_and_leaves_outliers_out():
    t = np.arange(30.0)
    c = (49 + 0.1 * t + 50) % 100 - 50
    c[12] = 0.0
    got = sequences.smoothed(t, c, np.full(30, 1.0), 4, 100.0, support=3)
    assert np.abs((got - (49 + 0.1 * t) + 50) % 100 - 50).max() < 0.05
    assert np.isnan(sequences.smoothed(t, np.full(30, np.nan), t, 4)).all()


def test_links_and_events():
    assert sequences.linked([0, 0, 1, 1, 3], [(0, 0), (10, 10), (1, 0), (30, 30), (2, 0)], gap=2, far=3) == [0, 1, 0, 2, 0]
    boxes = [(0, 0, 0, 4, 4, None), (0, 20, 20, 24, 24, "a"), (1, 1, 0, 5, 4, None), (5, 1, 0, 5, 4, None), (9, 0, 0, 1, 1, "a")]
    assert sequences.events_of_boxes(boxes, 0.25, 1) == [0, 1, 0, 2, 1]
