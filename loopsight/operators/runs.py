"""Whole runs filtered anew, compared, checked against a map without particles, and recurrence of single patches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopsight.functions import cyclic, scores
from loopsight.kernels import images
from loopsight.operators import agreement, build, evaluation, frames as kernels, recurrence, tracking, velocity
from loopsight.operators.ordered import stored


def period_state(height: int, period: float | None, reused: bool = False, metadata: dict | None = None) -> dict:
    """Whether a map of so many rows wraps, and how that's known.

    A fresh map wraps at the period supplied. A reused one at its metadata's period, which has to be
    its height; metadata may also say that it's a strip. Without either, the period supplied counts if
    it's the height.
    """
    meta = metadata or {}
    if not reused:
        known, source = period, "supplied" if period else "inferred_finite_strip"
    else:
        told = next((float(meta[k]) for k in ("model_period_px", "belt_model_period_px") if meta.get(k) not in (None, "")), None)
        if told is None and meta.get("belt_period_known") is True and meta.get("belt_period_px_input") not in (None, ""):
            told = float(meta["belt_period_px_input"])
        strip = meta.get("belt_map_periodic") is False or meta.get("belt_period_known") is False
        if told is not None and strip:
            raise ValueError("the metadata give a period and say that there is none")
        if told is None and (meta.get("belt_map_periodic") is True or meta.get("belt_period_known") is True):
            raise ValueError("the metadata say that the map wraps, but not where")
        if told is not None and abs(told - height) > 1e-6:
            raise ValueError("the metadata's period isn't the map's height")
        if told is not None:
            known, source = told, "metadata"
        elif strip:
            known, source = None, "metadata_finite_strip"
        elif period is not None and abs(period - height) <= 1e-6:
            known, source = float(period), "supplied_matching_reuse_height"
        else:
            known, source = None, "legacy_reuse_unknown"
    return {
        "belt_map_height_px": height, "model_period_px": known, "belt_period_known": known is not None, "belt_map_periodic": known is not None,
        "belt_period_state_source": source,
    }


def phases_of(frames: DataFrame, phases: DataFrame, velocity_: float | None, period: float) -> DataFrame:
    """frames with phase: the listed one, else that of the rounded number (half to even), else what the velocity gives."""
    known = phases.select(F.col("frame_index").cast("double").alias("_f"), F.col("phase").alias("_p"))
    near = known.withColumnsRenamed({"_f": "_g", "_p": "_q"})
    out = frames.join(known, F.col("frame_index").cast("double") == F.col("_f"), "left").join(near, F.rint(F.col("frame_index").cast("double")) == F.col("_g"), "left")
    model = F.lit(None).cast("double") if velocity_ is None else F.pmod(-F.lit(float(velocity_)) * F.col("frame_index"), F.lit(float(period)))
    return out.withColumn("phase", F.coalesce("_p", "_q", model)).drop("_f", "_p", "_g", "_q")


def previewed(frame: Column, first: int, every: int) -> Column:
    """Whether a frame is shown: one of the first, or each every-th."""
    return (frame < first) | ((frame % every == 0) if every > 0 else F.lit(False))


def inflated(frames: DataFrame, factor: Column) -> DataFrame:
    """frames with their noise times a factor of 1 or more, and the normalized signal divided by it."""
    f = F.greatest(factor, F.lit(1.0))
    out = frames.withColumn("_f", f)
    times = lambda c, op: F.transform(c, lambda x: op(x, F.col("_f")))
    return out.withColumns({"local_noise": times("local_noise", lambda x, y: x * y), "normalized": times("normalized", lambda x, y: x / y)}).drop("_f")


def ghost_tracks(tracks: DataFrame, track_scores: DataFrame, velocities: DataFrame, long: int) -> DataFrame:
    """track_id of tracks that can't be real where there are no particles: long ones and accepted ones.

    Without any of either and without scores, those with a velocity; without those too, all.
    """
    lengths = tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = lengths.where(F.col("n") >= long).select("track_id").union(track_scores.where("accepted").select("track_id")).distinct()
    if not chosen.isEmpty() or not track_scores.isEmpty():
        return chosen
    moving = velocities.select("track_id").distinct()
    return lengths.select("track_id") if moving.isEmpty() else moving


def filter_tracks(tracks: DataFrame, belt_velocity: float, **gates) -> dict[str, DataFrame]:
    """Velocities and scores of a run's tracks anew, and what of it is accepted."""
    v = velocity.least_squares(tracks, belt_velocity).where("v_y is not null")
    found = evaluation.score_velocities(v, **gates)
    good = found.where("accepted").select("track_id")
    return {"track_scores": found, "filtered_velocities": v.join(good, "track_id", "left_semi"), "filtered_tracks": tracks.join(good, "track_id", "left_semi")}


def _retracked(detections: DataFrame, belt_velocity: float, gate: float) -> dict[str, DataFrame]:
    links = tracking.track(detections, gate, 1.0, 0.8 * belt_velocity).drop("seq")
    tracks = detections.join(links, ["frame_index", "label"])
    return {"detections": detections, "tracks": tracks} | filter_tracks(tracks, belt_velocity)


def filter_artifacts(detections: DataFrame, phases: DataFrame, height: int, width: int, belt_velocity: float, gate: float, **how) -> dict[str, DataFrame]:
    """A run without the detections that recur in other revolutions, tracked anew."""
    scored = recurrence.score_leaving_own_out(detections, phases, height, width, **how)
    return {"scored": scored} | _retracked(scored.where("not rejected").select(*detections.columns), belt_velocity, gate)


def filter_recurring_tracks(tracks: DataFrame, phases: DataFrame, frame_height: float, height: float, **how) -> dict[str, DataFrame]:
    """Tracks without those that recur on the surface, and the scores of all."""
    found = recurrence.track_recurrence(tracks.select("track_id", "frame_index", "y", "x"), phases, frame_height, height, **how)
    return {"scores": found, "tracks": tracks.join(found.where("rejected").select("track_id"), "track_id", "left_anti")}


def confirmed_run(
    candidates: DataFrame, confirmers: DataFrame, belt_velocity: float, gate: float, min_iou: float = 0.1, max_distance: float = 4.0, unique: bool = False,
    tracks: DataFrame | None = None, rescue: tuple | None = None, dedupe: dict | None = None,
) -> dict[str, DataFrame]:
    """Detections that another run confirms, with members of tracks that it mostly confirms, without duplicates, tracked anew.

    rescue is (least detections, least confirmed, least share, frames or None) for the tracks given.
    """
    pairs = agreement.confirmation_pairs(candidates, confirmers)
    best = (agreement.one_to_one if unique else agreement.best_confirmation)(pairs, min_iou, max_distance)
    known = best.select("frame_index", "label", "confirmation_label", F.col("iou").alias("confirmation_iou"), F.col("distance").alias("confirmation_distance"))
    rows = candidates.join(known, ["frame_index", "label"], "left").withColumn("rescued", F.lit(False))
    kept = rows.where("confirmation_label is not null")
    if rescue and tracks is not None:
        more = agreement.rescued(tracks, kept, *rescue).select("frame_index", "label").distinct()
        again = rows.where("confirmation_label is null").join(more, ["frame_index", "label"], "left_semi").withColumn("rescued", F.lit(True))
        kept = kept.unionByName(again)
    if dedupe:
        kept = agreement.without_duplicates(kept, **dedupe).where("kept_label is null").drop("kept_label")
    return _retracked(kept, belt_velocity, gate)


def map_only_control(surface: np.ndarray, phases: DataFrame, rows: int, belt_velocity: float, threshold: float, gate: float, radius: int = 15, periodic: bool = True, gates: images.Gates = images.Gates(min_area=4), long: int = 5) -> DataFrame:
    """One row: what is detected and tracked in frames (frame_index, phase) drawn from the map alone, all of which is false."""
    flat = images.flat_map(surface, radius)
    width = surface.shape[1]
    drawn = phases.select("frame_index", "phase", F.lit(rows).alias("height"), F.lit(width).alias("width"))
    seen = kernels.expected(drawn, flat, "phase", periodic).withColumnRenamed("expected", "normalized")
    found = stored(kernels.detections(seen, threshold, None, "absolute", gates))
    links = tracking.track(found, gate, 1.0, 0.8 * belt_velocity)
    lengths = links.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("false_tracks"), F.count_if(F.col("n") >= long).alias("false_long_tracks"))
    accepted = build.velocities(found, belt_velocity, gate).agg(F.count_if("accepted").alias("false_accepted_tracks"))
    n = phases.agg(F.count(F.lit(1)).alias("frames"))
    return n.join(found.agg(F.count(F.lit(1)).alias("false_detections"))).join(lengths).join(accepted).withColumn("per_frame", F.col("false_detections") / F.col("frames"))


def evidence(image: np.ndarray, expected: np.ndarray, box: tuple[int, int, int, int]) -> tuple[np.ndarray, float]:
    """(residual, largest positive residual) of a patch."""
    top, left, bottom, right = box
    r = image[top:bottom, left:right] - expected[top:bottom, left:right]
    known = r[np.isfinite(r)]
    return r, max(0.0, float(known.max())) if len(known) else 0.0


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """How alike two patches are about their medians, -1 to 1; 0 for other shapes, fewer than four pixels or no spread."""
    if a.shape != b.shape:
        return 0.0
    ok = np.isfinite(a) & np.isfinite(b)
    if ok.sum() < 4:
        return 0.0
    x, y = a[ok] - np.median(a[ok]), b[ok] - np.median(b[ok])
    size = np.sqrt((x * x).sum() * (y * y).sum())
    return float(np.clip((x * y).sum() / size, -1, 1)) if size > 1e-12 else 0.0


def patch_recurrence(
    detections: DataFrame, frames: DataFrame, phases: DataFrame, surface: np.ndarray, height: int, width: int, margin: int = 4, least: int = 9,
    floor: float = 1.0, threshold: float = 0.4, revisits: int = 2,
) -> DataFrame:
    """Each detection's patch against the same place of the surface one revolution before and after.

    number, excess, ratio and correlation of either, valid_revisits, high_recurrence_revisits (where ratio
    times a positive correlation reaches the threshold), belt_fixedness_score, transient_score, hard_reject.
    frames hold frame_index, height, width and pixels; phases frame_index, phase and revolution.
    """
    n = len(surface)
    h = F.greatest(F.lit(least), F.col("bbox_bottom") - F.col("bbox_top") + 2 * margin)
    w = F.greatest(F.lit(least), F.col("bbox_right") - F.col("bbox_left") + 2 * margin)
    cy, cx = (F.col("bbox_top") + F.col("bbox_bottom")) * 0.5, (F.col("bbox_left") + F.col("bbox_right")) * 0.5
    top, left = F.rint(cy - h * 0.5), F.rint(cx - w * 0.5)
    whole = (top >= 0) & (left >= 0) & (top + h <= height) & (left + w <= width)
    cut = [F.greatest(F.lit(0), F.col("bbox_top") - margin), F.greatest(F.lit(0), F.col("bbox_left") - margin), F.least(F.lit(height), F.col("bbox_bottom") + margin), F.least(F.lit(width), F.col("bbox_right") + margin)]
    sides = [F.when(whole, a).otherwise(b).cast("long").alias(c) for a, b, c in zip((top, left, top + h, left + w), cut, ("t", "l", "b", "r"), strict=True)]
    rows = detections.withColumn("number", F.xxhash64("frame_index", "label")).join(phases.select("frame_index", F.col("phase").alias("_p")), "frame_index")
    rows = rows.select("number", "frame_index", "label", cyclic.surface_row(F.col("y"), F.col("_p"), n).alias("belt_y"), *sides)
    asked = None
    for step in (-1, 1):
        pairs = rows.join(phases.select("frame_index", "revolution"), "frame_index").join(
            phases.select(F.col("frame_index").alias("f"), F.col("phase").alias("p"), F.col("revolution").alias("q")), F.col("q") == F.col("revolution") + step
        )
        size = F.col("b") - F.col("t")
        pairs = pairs.withColumn("at", F.pmod(F.col("belt_y") - F.col("p"), F.lit(float(n)))).withColumn("t2", F.rint(F.col("at") - 0.5 * size).cast("long"))
        pairs = pairs.where((F.col("at") < height) & (F.col("t2") >= 0) & (F.col("t2") + size <= height))
        order = F.struct(F.abs(F.col("at") - height / 2).alias("a"), F.abs(F.col("f") - F.col("frame_index")).alias("g"), F.col("f").alias("f"))
        best = pairs.groupBy("number").agg(F.min_by(F.struct("f", "t2"), order).alias("m")).select("number", F.lit(step).alias("step"), "m.f", "m.t2")
        asked = best if asked is None else asked.unionByName(best)
    views = kernels.expected(frames.join(phases.select("frame_index", "phase"), "frame_index"), surface).select("frame_index", "height", "width", "pixels", "expected")
    own = rows.select("number", F.lit(0).alias("step"), F.col("frame_index").alias("f"), "t", "l", "b", "r")
    size = F.col("b") - F.col("t")
    other = asked.join(rows.select("number", "t", "l", "b", "r"), "number").select("number", "step", "f", F.col("t2").alias("t"), "l", (F.col("t2") + size).alias("b"), "r")
    patches = own.unionByName(other).join(views.withColumnRenamed("frame_index", "f"), "f")
    kind = pa.struct([("patch", pa.list_(pa.float64())), ("excess", pa.float64())])
    kernels.frame_batches(frames)

    @F.arrow_udf("patch array<double>, excess double")
    def cut_out(height: pa.Array, width: pa.Array, image: pa.Array, view: pa.Array, t: pa.Array, left: pa.Array, b: pa.Array, r: pa.Array) -> pa.Array:
        boxes = zip(*(c.to_pylist() for c in (t, left, b, r)), strict=True)
        found = [evidence(x, y, box) for (x, y), box in zip(kernels.arrays(height, width, image, view), boxes, strict=True)]
        return pa.array([{"patch": p.ravel(), "excess": e} for p, e in found], type=kind)

    @F.arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([correlation(np.array(x, float), np.array(y, float)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], type=pa.float64())

    seen = patches.select("number", "step", cut_out("height", "width", "pixels", "expected", "t", "l", "b", "r").alias("e")).select("number", "step", "e.*")
    first = seen.where("step = 0").select("number", F.col("patch").alias("p0"), F.col("excess").alias("e0"))
    met = seen.where("step <> 0").join(first, "number")
    met = met.select("number", "step", "e0", "excess", scores.recurrence_ratio(F.col("excess"), F.col("e0"), floor).alias("ratio"), alike("p0", "patch").alias("corr"))
    strength = F.least(F.lit(1.0), F.col("ratio")) * F.greatest(F.lit(0.0), F.col("corr"))
    sums = met.groupBy("number").agg(
        F.count(F.lit(1)).alias("valid_revisits"), F.max("ratio").alias("max_recurrence_ratio"), F.count_if(strength >= threshold).alias("high_recurrence_revisits"),
        F.sort_array(F.collect_list(strength), asc=False).alias("s"), *[F.max(F.when(F.col("step") == k, F.col(c))).alias(f"{c}_{name}") for k, name in ((-1, "prev"), (1, "next")) for c in ("excess", "ratio", "corr")],
    )
    out = rows.select("number", "frame_index", "label").join(first.select("number", F.col("e0").alias("original_excess")), "number", "left").join(sums, "number", "left")
    out = out.fillna(0, ["valid_revisits", "high_recurrence_revisits"]).fillna(0.0, ["max_recurrence_ratio"])
    fixed = F.when(F.col("valid_revisits") >= revisits, F.coalesce(F.get("s", F.lit(revisits - 1)), F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("belt_fixedness_score", fixed).drop("s", "number")
    return out.withColumns({
        "transient_score": F.least(F.lit(1.0), F.greatest(F.lit(0.05), 1 - F.col("belt_fixedness_score"))),
        "hard_reject": F.col("high_recurrence_revisits") >= revisits,
    })


def centroid_uncertainty(area: Column, major: Column, minor: Column, signal: Column, noise: Column) -> tuple[Column, Column]:
    """(y, x) uncertainty of a centroid: half an axis over the signal-to-noise ratio; null without signal or noise."""
    snr = signal / (noise * F.sqrt(area))
    ok = (signal > 0) & (noise > 0)
    return F.when(ok, minor / (2 * snr)), F.when(ok, major / (2 * snr))


def compared_runs(runs: dict[str, dict[str, DataFrame]], truth: DataFrame, frames: DataFrame, least: float = 0.25) -> DataFrame:
    """run and detection metrics of each run's detections on the scored frames; a job for each run."""
    out = None
    for name, tables in runs.items():
        row = evaluation.detection_metrics(tables["detections"], truth, least, frames).withColumn("run", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
