from conftest import TINY
from loopsight import catalogue
from loopsight.operators import matching
from loopsight.sources import views


def iou(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = sum((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)) - both
    return both / union if union else 0.0


def plain(detections, truth, threshold):
    """tp and fp of the detections (frame, label, score, box) at a threshold, matched greedily frame by frame."""
    kept = sorted(d for d in detections if d[2] >= threshold)
    tp = 0
    for frame in {d[0] for d in kept}:
        mine, boxes = [d for d in kept if d[0] == frame], [t[2] for t in sorted(truth) if t[0] == frame]
        pairs = sorted(((iou(d[3], t), i, j) for i, d in enumerate(mine) for j, t in enumerate(boxes)), reverse=True)
        a, b = set(), set()
        for x, i, j in pairs:
            if x >= 0.25 and i not in a and j not in b:
                a.add(i)
                b.add(j)
        tp += len(a)
    return tp, len(kept) - tp


D = "frame_index long, label long, peak_signal double, bbox_top int, bbox_left int, bbox_bottom int, bbox_right int"
T = "frame_index long, truth_id long, t_top int, t_left int, t_bottom int, t_right int"


def test_each_threshold_is_matched_anew(spark):
    # the box's best detection has the lower score; both scores lie within one whole number
    found = [(1, 1, 0.9, (0, 0, 10, 8)), (1, 2, 0.2, (0, 0, 10, 10)), (2, 1, 0.5, (50, 50, 60, 60))]
    truth = [(1, 1, (0, 0, 10, 10)), (2, 1, (0, 0, 5, 5))]
    curve = matching.froc_rematched(
        spark.createDataFrame([(*d[:3], *d[3]) for d in found], D), spark.createDataFrame([(*t[:2], *t[2]) for t in truth], T), 2
    ).collect()
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in curve}
    assert got == {None: (0, 0), 0.9: (1, 0), 0.5: (1, 1), 0.2: (1, 2)}
    assert {r["threshold"]: r["envelope"] for r in curve} == {None: 0.5, 0.9: 0.5, 0.5: 0.5, 0.2: 0.5}


def test_query_against_plain_python(spark):
    box = lambda r, p: tuple(r[p + x] for x in ("top", "left", "bottom", "right"))
    found = [(r["frame_index"], r["label"], r["peak_signal"], box(r, "bbox_")) for r in views.detections(spark, TINY).collect()]
    truth = [(r["frame_index"], r["truth_id"], box(r, "t_")) for r in views.truth(spark, TINY).collect()]
    # few frames for speed: the query's operator on the first of them
    frames = set(sorted({d[0] for d in found})[:60])
    found, truth = ([x for x in y if x[0] in frames] for y in (found, truth))
    few = [x.where(x["frame_index"].isin(list(frames))) for x in (views.detections(spark, TINY), views.truth(spark, TINY))]
    curve = [r for r in matching.froc_rematched(*few, len(frames)).collect() if r["threshold"] is not None]
    assert {r["threshold"] for r in curve} == {d[2] for d in found}
    assert all((r["tp"], r["fp"]) == plain(found, truth, r["threshold"]) for r in curve)
    assert catalogue.QUERIES["froc_rematched"](spark, TINY).count() > len(curve)
