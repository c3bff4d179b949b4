"""Sequential operators: tracks, drift, smoothing, events. One sequence is one group; frames of it come in order.

In a stream the state of a sequence is kept from batch to batch; what it holds is bounded by the
tracks that are still alive.
"""

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loopsight.kernels import sequences

_TRACKED = "seq string, frame_index long, label long, track_id long"


def _value(x) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


def _steps(tracker: sequences.Tracker, rows: pd.DataFrame) -> pd.DataFrame:
    """Track numbers of rows, frame by frame; within a frame rows are taken by place."""
    out = []
    rows = rows.sort_values(["frame_index", "y", "x", "label"], kind="stable")
    for frame, some in rows.groupby("frame_index", sort=True):
        found = [(r.y, r.x, _value(r.area_px), _value(r.peak_signal)) for r in some.itertuples()]
        for r, number in zip(some.itertuples(), tracker.step(float(frame), found), strict=True):
            out.append((r.seq, int(frame), r.label, number))
    return pd.DataFrame(out, columns=["seq", "frame_index", "label", "track_id"])


def _columns(detections: DataFrame, seq: str | None) -> DataFrame:
    name = F.col(seq).cast("string") if seq else F.lit("")
    return detections.select(name.alias("seq"), F.col("frame_index").cast("long"), F.col("label").cast("long"), F.col("y").cast("double"), F.col("x").cast("double"), F.col("area_px").cast("double"), F.col("peak_signal").cast("double"))


def track(detections: DataFrame, gate: float, max_gap: float = 1.0, prior_y: float = 0.0, prior_x: float = 0.0, seq: str | None = None) -> DataFrame:
    """seq, frame_index, label, track_id of each detection (y, x, area_px, peak_signal); a sequence is one group of one task."""

    def tracked(rows: pd.DataFrame) -> pd.DataFrame:
        return _steps(sequences.Tracker(gate, max_gap, prior_y, prior_x), rows)

    return _columns(detections, seq).groupBy("seq").applyInPandas(tracked, _TRACKED)


def track_stream(detections: DataFrame, gate: float, max_gap: float = 1.0, prior_y: float = 0.0, prior_x: float = 0.0, seq: str | None = None) -> DataFrame:
    """track of a stream: the rows of a batch are of later frames than those before it; the state is the tracks still alive."""

    def tracked(key: tuple, batches, state: GroupState):
        tracker = sequences.Tracker(gate, max_gap, prior_y, prior_x)
        if state.exists:
            made, alive = state.get
            tracker.made = made
            tracker.alive = {int(i): [tuple(r) for r in rows] for i, rows in json.loads(alive).items()}
        rows = pd.concat(list(batches), ignore_index=True)
        out = _steps(tracker, rows)
        state.update((tracker.made, json.dumps(tracker.alive)))
        yield out

    return _columns(detections, seq).groupBy("seq").applyInPandasWithState(tracked, _TRACKED, "made long, alive string", "append", GroupStateTimeout.NoTimeout)


def drift(estimates: DataFrame, alpha: float = 0.15, min_score: float = 0.05, max_step: float | None = None, max_drift: float | None = None, seq: str | None = None) -> DataFrame:
    """seq, frame_index, drift_px (before each frame) and accepted, along the frames of a sequence."""

    def followed(rows: pd.DataFrame) -> pd.DataFrame:
        f = sequences.DriftFilter(alpha, min_score, max_step, max_drift)
        rows = rows.sort_values("frame_index", kind="stable")
        steps = [f.step(_value(c), _value(s)) for c, s in zip(rows["correction_px"], rows["score"], strict=True)]
        return rows[["seq", "frame_index"]].assign(drift_px=[d for d, _ in steps], accepted=[a for _, a in steps])

    name = F.col(seq).cast("string") if seq else F.lit("")
    rows = estimates.select(name.alias("seq"), F.col("frame_index").cast("long"), F.col("correction_px").cast("double"), F.col("score").cast("double"))
    return rows.groupBy("seq").applyInPandas(followed, "seq string, frame_index long, drift_px double, accepted boolean")


def smooth_phases(estimates: DataFrame, radius: float, period: float | None = None, seq: str | None = None, **how) -> DataFrame:
    """seq, frame_index, correction_px smoothed over neighbouring frames, phase_px; a correction that nothing is near stays."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_index", kind="stable")
        t, c, s = (rows[x].to_numpy(dtype=float) for x in ("frame_index", "correction_px", "score"))
        new = sequences.smoothed(t, c, s, radius, period, **how) if radius > 0 else c
        new = np.where(np.isfinite(new), new, c)
        phase = rows["predicted_phase_px"].to_numpy(dtype=float) + new
        return rows[["seq", "frame_index"]].assign(correction_px=new, phase_px=phase % period if period else phase)

    name = F.col(seq).cast("string") if seq else F.lit("")
    rows = estimates.select(name.alias("seq"), F.col("frame_index").cast("long"), *[F.col(c).cast("double") for c in ("predicted_phase_px", "correction_px", "score")])
    return rows.groupBy("seq").applyInPandas(one, "seq string, frame_index long, correction_px double, phase_px double")


def kalman(phases: DataFrame, phase: str, period: float, seq: str | None = None, process: float = 0.1, measured: float = 2.0) -> DataFrame:
    """seq, frame_index, phase_px, velocity after each frame, by a filter of constant velocity over a sequence."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_index", kind="stable")
        p, v = sequences.kalman(rows["p"].to_numpy(dtype=float), period, rows["score"].to_numpy(dtype=float), process, measured)
        return rows[["seq", "frame_index"]].assign(phase_px=p, velocity=v)

    name = F.col(seq).cast("string") if seq else F.lit("")
    rows = phases.select(name.alias("seq"), F.col("frame_index").cast("long"), F.col(phase).cast("double").alias("p"), F.col("score").cast("double"))
    return rows.groupBy("seq").applyInPandas(one, "seq string, frame_index long, phase_px double, velocity double")


def short_links(detections: DataFrame, gap: float, far: float, seq: str | None = None) -> DataFrame:
    """seq, frame_index, label, link_id: detections joined to the nearest end of a short track within reach."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_index", "y", "x", "label"], kind="stable")
        ids = sequences.linked(rows["frame_index"].tolist(), list(zip(rows["y"], rows["x"], strict=True)), gap, far)
        return rows[["seq", "frame_index", "label"]].assign(link_id=ids)

    return _columns(detections, seq).groupBy("seq").applyInPandas(one, "seq string, frame_index long, label long, link_id long")


def box_events(boxes: DataFrame, least: float = 0.25, gap: float = 1.0, seq: str | None = None) -> DataFrame:
    """seq, number, event of boxes (number, frame_index, bbox_*, event_id): boxes of an id together, others linked by overlap."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_index", "number"], kind="stable")
        found = [(r.frame_index, r.bbox_top, r.bbox_left, r.bbox_bottom, r.bbox_right, None if pd.isna(r.event_id) else r.event_id) for r in rows.itertuples()]
        return rows[["seq", "number"]].assign(event=sequences.events_of_boxes(found, least, gap))

    name = F.col(seq).cast("string") if seq else F.lit("")
    sides = [F.col(f"bbox_{s}").cast("double") for s in ("top", "left", "bottom", "right")]
    rows = boxes.select(name.alias("seq"), F.col("number").cast("long"), F.col("frame_index").cast("double"), *sides, F.col("event_id").cast("string"))
    return rows.groupBy("seq").applyInPandas(one, "seq string, number long, event long")


def event_pairs(predicted: DataFrame, target: DataFrame, least: float = 0.25) -> DataFrame:
    """event, target, temporal_iou, coverage, latency, shared of events (event, frame_index, box) that overlap in at least one frame.

    temporal_iou is shared frames over all frames of both; coverage the share of the target's; latency
    how many frames after the target's first the first shared one is. Only the best box of a frame counts.
    """
    from loopsight.functions import boxes

    a, b = boxes.sides("bbox_"), boxes.sides("t_")
    renamed = target.select(F.col("event").alias("target"), "frame_index", *[F.col(f"bbox_{s}").alias(f"t_{s}") for s in boxes.SIDES])
    met = predicted.join(renamed, "frame_index").where(boxes.iou(a, b) >= least).select("event", "target", "frame_index").distinct()
    span = lambda df, key, p: df.groupBy(F.col(key)).agg(F.countDistinct("frame_index").alias(f"{p}n"), F.min("frame_index").alias(f"{p}first"))
    shared = met.groupBy("event", "target").agg(F.count(F.lit(1)).alias("shared"), F.min("frame_index").alias("first"))
    out = shared.join(span(predicted, "event", "p"), "event").join(span(renamed, "target", "q"), "target")
    return out.select(
        "event", "target", (F.col("shared") / (F.col("pn") + F.col("qn") - F.col("shared"))).alias("temporal_iou"), (F.col("shared") / F.col("qn")).alias("coverage"),
        (F.col("first") - F.col("qfirst")).alias("latency"), "shared",
    )


def event_metrics(predicted: DataFrame, target: DataFrame, least: float = 0.25) -> DataFrame:
    """One row: events matched one to one (the most pairs, then the largest temporal IoU), their measures, and targets in several pieces."""
    from loopsight.operators.assignment import optimal_pairs

    pairs = event_pairs(predicted, target, least).withColumn("all", F.lit(0))
    best = optimal_pairs(pairs, "event", "target", [F.col("temporal_iou")], ["all"])
    counts = predicted.agg(F.countDistinct("event").alias("predicted")).join(target.agg(F.countDistinct("event").alias("targets")))
    sums = best.agg(F.count(F.lit(1)).alias("matched"), F.avg("temporal_iou").alias("temporal_iou"), F.avg("coverage").alias("coverage"), F.avg("latency").alias("latency"))
    pieces = pairs.groupBy("target").agg(F.countDistinct("event").alias("n")).agg(F.count_if(F.col("n") > 1).alias("fragmented"))
    out = counts.join(sums).join(pieces)
    n = F.col("matched")
    p, r = F.when(F.col("predicted") > 0, n / F.col("predicted")), F.when(F.col("targets") > 0, n / F.col("targets"))
    return out.withColumns({"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).when((p == 0) & (r == 0), 0.0)})
