"""Summaries, warnings and audits of a run's tables; each gives one row unless it says otherwise."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopsight.functions.cyclic import finite


def described(values: Column, prefix: str, low: float = 0.25, high: float = 0.75, names: tuple = ("q25", "q75")) -> list[Column]:
    """Aggregates of the finite values: count, mean, median, min, max and two percentiles."""
    x = finite(values.cast("double"))
    parts = {"count": F.count(x), "mean": F.avg(x), "median": F.median(x), "min": F.min(x), "max": F.max(x)}
    parts |= {names[0]: F.percentile(x, F.lit(low)), names[1]: F.percentile(x, F.lit(high))}
    return [c.alias(f"{prefix}{n}") for n, c in parts.items()]


def summary(values: Column, prefix: str = "") -> list[Column]:
    """described, with the 5th and 95th percentiles."""
    return described(values, prefix, 0.05, 0.95, ("p05", "p95"))


def share(condition: Column, of: Column | None = None) -> Column:
    """An aggregate: how many of the rows (those where `of` isn't null) hold; null without any."""
    n = F.count(F.lit(1)) if of is None else F.count(of)
    return F.when(n > 0, F.count_if(condition) / n)


def _side_by_side(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # tables of one row
    return out


def _warnings(*said: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in said]))


def detection_quality(detections: DataFrame, small: float = 10.0, threshold: float | None = None, margin: float = 1.0) -> DataFrame:
    """Small and barely visible detections: counts, shares and the spread of areas and peaks."""
    area, peak = finite(F.col("area_px").cast("double")), finite(F.col("peak_signal").cast("double"))
    aggs = [F.count_if(area < small).alias("small_detections"), share(area < small, area).alias("small_share")]
    if threshold is not None:
        near = peak.between(threshold, threshold + margin)
        aggs += [F.count_if(near).alias("near_threshold"), share(near, peak).alias("near_threshold_share")]
    return detections.agg(*aggs, *described(area, "area_"), *described(peak, "peak_"))


def track_quality(tracks: DataFrame, small: float = 10.0, long: int = 5, very_long: int = 10) -> DataFrame:
    """Tracks whose mean area is small although they're accepted, and the spread of lengths and areas."""
    each = tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.avg("area_px").alias("mean"), F.median("area_px").alias("middle"))
    tiny = F.col("mean") < small
    return each.agg(
        F.sum("n").alias("track_rows"), F.count(F.lit(1)).alias("tracks"), F.count("mean").alias("tracks_with_area"), F.count_if(tiny).alias("small_tracks"),
        share(tiny, F.col("mean")).alias("small_share"), F.count_if(tiny & (F.col("n") >= long)).alias("long_small_tracks"),
        F.count_if(tiny & (F.col("n") >= very_long)).alias("very_long_small_tracks"), *described(F.col("n"), "length_"), *described(F.col("mean"), "mean_area_"),
        *described(F.col("middle"), "median_area_"),
    )


def track_continuity(tracks: DataFrame) -> DataFrame:
    """Lengths and spans of tracks in frames, and how many have a single row."""
    each = tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), (F.max("frame_index") - F.min("frame_index") + 1).alias("span"))
    return each.agg(
        F.sum("n").alias("track_rows"), F.count(F.lit(1)).alias("tracks"), F.avg("n").alias("mean_track_length"), F.median("n").alias("median_track_length"),
        F.max("n").alias("max_track_length"), F.count_if(F.col("n") == 1).alias("single_frame_tracks"), share(F.col("n") == 1).alias("single_frame_share"),
        F.avg("span").alias("mean_span"), F.median("span").alias("median_span"),
    )


def velocity_errors(velocities: DataFrame, truth: float | None) -> DataFrame:
    """Spread of v_y, and its errors against the true velocity (null without)."""
    v = finite(F.col("v_y").cast("double"))
    e = F.lit(None).cast("double") if truth is None else v - F.lit(float(truth))
    return velocities.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.avg(F.abs(e)).alias("mean_abs_error"), F.avg(e).alias("bias"),
        F.stddev_pop(e).alias("error_std"), F.var_pop(e).alias("error_variance"),
    )


def representative_velocity(velocities: DataFrame, true_ratio: float | None) -> DataFrame:
    """The row with most detections, then the ratio nearest to truth, then the smallest track_id; rows without velocity and ratio don't count."""
    off = F.lit(float("inf")) if true_ratio is None else F.coalesce(F.abs(finite(F.col("ratio")) - true_ratio), F.lit(float("inf")))
    known = velocities.where(finite(F.col("v_y")).isNotNull() | finite(F.col("ratio")).isNotNull())
    best = known.agg(F.min_by(F.struct(*known.columns), F.struct((-F.coalesce("n_detections", F.lit(0))).alias("n"), off.alias("off"), "track_id")).alias("r"))
    return best.where("r is not null").select("r.*")


def truth_matched_velocity(velocities: DataFrame, true_velocity: float | None, true_ratio: float | None) -> DataFrame:
    """The row nearest to the true ratio, then velocity, then with most detections; none where neither can be compared."""
    inf = F.lit(float("inf"))
    off = lambda c, t: inf if t is None else F.coalesce(F.abs(finite(F.col(c)) - t), inf)
    rows = velocities.withColumns({"_r": off("ratio", true_ratio), "_v": off("v_y", true_velocity)}).where((F.col("_r") < inf) | (F.col("_v") < inf))
    key = F.struct("_r", "_v", (-F.coalesce("n_detections", F.lit(0))).alias("n"), "track_id")
    return rows.agg(F.min_by(F.struct(*velocities.columns), key).alias("r")).where("r is not null").select("r.*")


def events_of_tracks(tracks: DataFrame) -> DataFrame:
    """A row for each track: first and last frame, rows, median place and peak, and least-squares velocities."""
    t = F.col("frame_index").cast("double")
    return tracks.groupBy("track_id").agg(
        F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count(F.lit(1)).alias("n_observations"),
        F.median("y").alias("y"), F.median("x").alias("x"), F.median("peak_signal").alias("peak_signal_median"),
        F.regr_slope(F.col("y"), t).alias("v_y"), F.regr_slope(F.col("x"), t).alias("v_x"),
    )


def flux(velocities: DataFrame, frames: int | None = None, rate: float | None = None, seconds: float | None = None, accepted_only: bool = False) -> DataFrame:
    """Rows a second and the spread of velocity ratios; without a rate the mean velocity in pixels a second is null."""
    rows = velocities.where("accepted") if accepted_only else velocities
    rate = rate if rate and rate > 0 else None
    if seconds is None and frames is not None and rate:
        seconds = frames / rate
    ratio, v = finite(F.col("ratio").cast("double")), finite(F.col("v_y").cast("double"))
    per = F.count(F.lit(1)) / F.lit(float(seconds)) if seconds and seconds > 0 else F.lit(None).cast("double")
    return _side_by_side(velocities.agg(F.count(F.lit(1)).alias("n_velocity_rows")), rows.agg(
        F.count(F.lit(1)).alias("n_accepted_rows"), F.lit(seconds).cast("double").alias("duration_s"), per.alias("particle_flux_per_s"),
        F.median(ratio).alias("median_ratio"), F.percentile(ratio, F.lit(0.25)).alias("q25_ratio"), F.percentile(ratio, F.lit(0.75)).alias("q75_ratio"),
        (F.avg(v) * F.lit(rate).cast("double")).alias("mean_velocity_px_per_s"), F.median("speed").alias("median_speed"),
    ))


def physical_check(events: DataFrame, seconds: float | None, expected_flux: float | None = None, mass: float | None = None, expected_mass: float | None = None) -> DataFrame:
    """Events a second against an independent count, and their mass against a weighed one, with warnings beyond a quarter."""
    null = F.lit(None).cast("double")
    n = events.agg(F.count(F.lit(1)).alias("event_count"))
    per = F.col("event_count") / F.lit(float(seconds)) if seconds else null
    weight = per * float(mass) if mass else null
    error = lambda x, e: (x - F.lit(float(e))) / F.lit(float(e)) if e else null
    out = n.withColumns({"particle_flux_per_s": per, "mass_flux_g_s": weight, "flux_error": error(per, expected_flux), "mass_error": error(weight, expected_mass)})
    return out.withColumn("warnings", _warnings(
        (F.abs("flux_error") > 0.25, "image-derived particle flux differs from expected flux by more than 25%"),
        (F.abs("mass_error") > 0.25, "estimated mass flux differs from expected mass flux by more than 25%"),
        (F.lit(not seconds), "duration unavailable; provide frame_rate_hz or analysis_duration_s for flux validation"),
    ))


def speed_consistency(phases: DataFrame, velocity: float | None, radius: float | None) -> DataFrame:
    """The trend of corrections over frames, the velocity it implies, and how often corrections reach the search's edge."""
    c, t, s = (finite(F.col(x).cast("double")) for x in ("correction_px", "frame_index", "score"))
    rows = phases.select(F.when(t.isNotNull() & c.isNotNull(), c).alias("c"), t.alias("t"), F.when(t.isNotNull() & c.isNotNull(), s).alias("s"))
    edge = F.lit(False) if radius is None else F.abs(F.abs("c") - radius) <= 1e-9
    out = rows.agg(F.count(F.lit(1)).alias("phase_rows"), F.regr_slope("c", "t").alias("slope"), F.count_if(edge).alias("boundary_hits"), *summary(F.col("s"), "score_"))
    implied = F.lit(None).cast("double") if velocity is None else F.lit(float(velocity)) - F.col("slope")
    return out.withColumn("inferred_velocity", implied).withColumn("warnings", _warnings(
        (F.abs("slope") > 0.05, "phase corrections show a non-trivial linear trend; supplied belt velocity may be biased"),
        (F.col("boundary_hits") > 0.05 * F.col("phase_rows"), "more than 5% of registration corrections hit the search boundary"),
        (F.col("score_median") < 0.1, "median registration score is low"),
    ))


def drift(per_frame: DataFrame, phases: DataFrame) -> DataFrame:
    """Trends over frames of detections, corrections and registration losses, their spreads, and warnings."""
    n = per_frame.agg(F.regr_slope("n_detections", "frame_index").alias("detection_slope"), *summary(F.col("n_detections"), "detections_"))
    c, loss = finite(F.col("correction_px").cast("double")), finite(F.col("loss").cast("double"))
    p = phases.agg(
        F.regr_slope(c, F.col("frame_index")).alias("correction_slope"), F.regr_slope(loss, F.col("frame_index")).alias("loss_slope"),
        *summary(c, "correction_"), *summary(loss, "loss_"),
    )
    return _side_by_side(n, p).withColumn("warnings", _warnings(
        (F.abs("detection_slope") > 0.01, "detection counts drift over time; check contamination, illumination drift, or threshold stability"),
        (F.col("loss_slope") > 0, "registration loss increases over time; consider multi-epoch maps or illumination correction"),
        (F.abs("correction_slope") > 0.05, "phase correction drift suggests speed or timing mismatch"),
    ))


def worst_frames(phases: DataFrame, per_frame: DataFrame, rejections: DataFrame, fits: DataFrame, n: int = 10) -> DataFrame:
    """bucket, frame_index, value: the n worst frames by each of six measures; ties to the smaller frame.

    rejections are rejected detections (frame_index), fits (frame_index, rmse_gray).
    """
    rejected = rejections.groupBy("frame_index").agg(F.count(F.lit(1)).alias("v"))
    tables = (
        ("low_registration_score", phases, finite(F.col("score")), False), ("large_phase_correction", phases, F.abs(finite(F.col("correction_px"))), True),
        ("detection_spikes", per_frame, F.col("n_detections").cast("double"), True), ("empty_or_low_detection_frames", per_frame, F.col("n_detections").cast("double"), False),
        ("recurrent_rejections", rejected, F.col("v").cast("double"), True), ("photometric_rmse", fits, finite(F.col("rmse_gray")), True),
    )
    out = None
    for name, rows, value, down in tables:
        rows = rows.select(F.lit(name).alias("bucket"), "frame_index", value.alias("value")).where("value is not null")
        rows = rows.orderBy(F.desc("value") if down else F.asc("value"), "frame_index").limit(n)
        out = rows if out is None else out.unionByName(rows)
    return out


#: Roles of the buckets that frames to label are taken from, in the order in which they are filled up.
BUCKETS = {
    "empty_or_low_detection_frames": "negative_control", "detection_spikes": "spike", "low_registration_score": "registration",
    "large_phase_correction": "registration", "recurrent_rejections": "artifact", "photometric_rmse": "photometric",
}


def suggest_frames(worst: DataFrame, count: int, empty: int | None = None, gap: int = 0, controls: list[int] = ()) -> list[tuple[int, str]]:
    """(frame, bucket) of up to count frames to label, from worst frames of each bucket; a short list chosen on the driver.

    First `empty` frames with few detections, then an equal quota of the other buckets, then any that
    are left, then controls; frames keep `gap` frames apart.
    """
    empty = max(1, min(10, -(-count // 5))) if empty is None else min(empty, count)
    rows: dict[str, list[int]] = {}
    for r in worst.select("bucket", "frame_index").collect():  # a few rows of each bucket, in order
        rows.setdefault(r["bucket"], []).append(r["frame_index"])
    chosen: dict[int, str] = {}

    def add(bucket: str, frames: list[int], limit: int | None) -> None:
        taken = sum(b == bucket for b in chosen.values())
        for f in frames:
            if len(chosen) >= count or (limit is not None and taken >= limit):
                return
            if f not in chosen and all(abs(f - c) > gap for c in chosen):
                chosen[f] = bucket
                taken += 1

    first, *others = BUCKETS
    add(first, rows.get(first, []), empty)
    quota = max(1, -(-(count - len(chosen)) // len(others)))
    for b in others:
        add(b, rows.get(b, []), quota)
    for b in BUCKETS:
        add(b, rows.get(b, []), None)
    add("regular_control", list(controls), None)
    return sorted(chosen.items())


def label_template(spark, chosen: list[tuple[int, str]]) -> DataFrame:
    """Rows to fill in: a frame, an empty box, its role and why it was chosen."""
    rows = [(f, None, None, None, None, BUCKETS.get(b, "control"), b, "", "") for f, b in chosen]
    box = ", ".join(f"bbox_{s} long" for s in ("top", "left", "bottom", "right"))
    return spark.createDataFrame(rows, f"frame_index long, {box}, annotation_role string, reason string, label_status string, review_notes string")


def _measures(phases: DataFrame, per_frame: DataFrame, detections: DataFrame, velocities: DataFrame, fits: DataFrame | None, radius: float, step: float, rejected: int) -> DataFrame:
    c, area, ratio = finite(F.col("correction_px")), finite(F.col("area_px").cast("double")), finite(F.col("ratio"))
    parts = [
        phases.agg(share(F.abs(F.abs(c) - radius) <= max(1e-9, 0.5 * step), c).alias("boundary")),
        per_frame.agg(F.percentile("n_detections", F.lit(0.95)).alias("p95"), F.median("n_detections").alias("median")),
        detections.agg(share(area <= 2, area).alias("tiny"), F.when(F.count(F.lit(1)) + rejected > 0, F.lit(float(rejected)) / (F.count(F.lit(1)) + rejected)).alias("rejected")),
        velocities.agg(share(ratio.between(0.0, 1.1), ratio).alias("in_range")),
    ]
    if fits is not None:
        gain = finite(F.col("gain"))
        parts.append(fits.agg(share((gain < 0.75) | (gain > 1.25), gain).alias("extreme_gain")))
    return _side_by_side(*parts)


def quality_flags(phases: DataFrame, per_frame: DataFrame, detections: DataFrame, velocities: DataFrame, fits: DataFrame | None = None, radius: float = 8.0, step: float = 1.0, rejected: int = 0) -> DataFrame:
    """severity, code, value, limit: a row for each warning sign of a poor run."""
    m = _measures(phases, per_frame, detections, velocities, fits, radius, step, rejected)
    spike = F.greatest(F.lit(25.0), 5 * (F.col("median") + 1))
    rules = [
        ("warning", "registration_boundary", F.col("boundary"), F.lit(0.05), F.col("boundary") > 0.05),
        ("warning", "detection_spikes", F.col("p95"), spike, F.col("p95") > spike),
        ("warning", "many_tiny_components", F.col("tiny"), F.lit(0.5), F.col("tiny") > 0.5),
        ("warning", "implausible_velocity_ratios", F.col("in_range"), F.lit(0.5), F.col("in_range") < 0.5),
        ("info", "heavy_recurrent_filtering", F.col("rejected"), F.lit(0.75), F.col("rejected") > 0.75),
    ]
    if fits is not None:
        rules.append(("warning", "photometric_gain_drift", F.col("extreme_gain"), F.lit(0.1), F.col("extreme_gain") > 0.1))
    rows = [F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("code"), v.cast("double").alias("value"), x.cast("double").alias("limit"))) for s, n, v, x, c in rules]
    return m.select(F.inline(F.array_compact(F.array(*rows))))


#: Limits of quality_contract unless others are given.
CONTRACT = {
    "registration_boundary_share": 0.05, "many_tiny_component_share": 0.5, "velocity_ratio_in_range_share": 0.5, "recurrent_rejection_share": 0.75,
    "filtered_velocity_estimates": 1.0,
}


def quality_contract(phases: DataFrame, per_frame: DataFrame, detections: DataFrame, velocities: DataFrame, filtered: DataFrame, contract: dict = CONTRACT, radius: float = 8.0, step: float = 1.0, rejected: int = 0) -> DataFrame:
    """name, passed, value, limit of each check that the contract names; one that can't be measured passes."""
    m = _measures(phases, per_frame, detections, velocities, None, radius, step, rejected).join(filtered.agg(F.count(F.lit(1)).cast("double").alias("kept")))
    at_most = {"registration_boundary_share": "boundary", "many_tiny_component_share": "tiny", "recurrent_rejection_share": "rejected"}
    at_least = {"velocity_ratio_in_range_share": "in_range", "filtered_velocity_estimates": "kept"}
    rows = []
    for name, limit in contract.items():
        value = F.col((at_most | at_least)[name])
        ok = value <= limit if name in at_most else value >= limit
        rows.append(F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(True)).alias("passed"), value.alias("value"), F.lit(float(limit)).alias("limit")))
    return m.select(F.inline(F.array(*rows)))


def failure_modes(measures: DataFrame) -> DataFrame:
    """code, severity: warnings of one row of run measures; measures that are missing are taken to be fine."""
    value = lambda c, d: F.coalesce(finite(F.col(c).cast("double")) if c in measures.columns else F.lit(None).cast("double"), F.lit(d))
    rules = (
        ("registration-search-boundary", "high", value("phase_boundary_fraction", 0.0) > 0.1),
        ("low-registration-score", "high", value("registration_score_median", 1.0) < 0.2),
        ("many-small-components", "medium", value("small_component_share_area_le_8", 0.0) > 0.5),
        ("implausible-velocity-ratios", "high", value("velocity_ratio_share_0_to_1", 1.0) < 0.5),
        ("low-map-coverage", "medium", value("map_low_coverage_fraction", 0.0) > 0.05),
        ("track-fragmentation", "medium", value("track_fragmentation", 0.0) > 0.5),
    )
    rows = [F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules]
    return measures.select(F.inline(F.array_compact(F.array(*rows))))


def rejection_audit(detections: DataFrame, scores: DataFrame) -> DataFrame:
    """source, frame_index, track_id, reason and failed gates of rejected detections and of tracks that weren't accepted."""
    no = F.lit(False)
    one = detections.where("rejected").select(
        F.lit("detections").alias("source"), "frame_index", F.lit(None).cast("long").alias("track_id"), F.lit("recurrent_artifact").alias("reason_rejected"),
        F.lit(True).alias("failed_artifact_gate"), no.alias("failed_track_gate"), no.alias("failed_velocity_gate"),
    )
    yes = lambda c: F.coalesce(F.col(c), no)
    names = (("passes_length", "track_length"), ("passes_ratio", "velocity_ratio"), ("passes_lateral", "lateral_velocity"))
    reasons = F.concat_ws("+", *[F.when(~yes(c), F.lit(n)) for c, n in names])
    other = scores.where(~yes("accepted")).select(
        F.lit("tracks").alias("source"), F.lit(None).cast("long").alias("frame_index"), "track_id",
        F.when(reasons == "", "track_filter").otherwise(reasons).alias("reason_rejected"), no.alias("failed_artifact_gate"),
        (~yes("passes_length")).alias("failed_track_gate"), (~yes("passes_ratio") | ~yes("passes_lateral")).alias("failed_velocity_gate"),
    )
    return one.unionByName(other)


def metadata_differences(runs: DataFrame, keys: list[str]) -> DataFrame:
    """key, n: the keys whose values differ between runs (null is a value), and how many values there are."""
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("null"))
    counts = runs.agg(*[F.countDistinct(text(k)).alias(k) for k in keys])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("n")) for k in keys]))).where("n > 1")


def kept_and_rejected(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("rejected")).alias("rejected"), F.count_if(~F.col("rejected")).alias("kept"))


def runtime(progress: DataFrame) -> DataFrame:
    """Elapsed seconds, frames, frames a second and peak memory of a progress log."""
    out = progress.agg(F.max("elapsed_s").alias("elapsed_s"), F.max("frames").alias("frames"), F.max("peak_rss_mb").alias("peak_rss_mb"))
    return out.withColumn("frames_per_second", F.when(F.col("elapsed_s") > 0, F.col("frames") / F.col("elapsed_s")))


def run_summary(phases: DataFrame, per_frame: DataFrame, detections: DataFrame, velocities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a run (or one in all): counts and the spread of corrections, scores, detections and velocity ratios."""
    c, s, r = F.abs(finite(F.col("correction_px"))), finite(F.col("score")), finite(F.col("ratio"))
    p50, p95 = F.lit(0.5), F.lit(0.95)
    aggs = (
        (phases, [F.count(F.lit(1)).alias("n_phase_estimates"), F.percentile(c, p50).alias("correction_abs_median"), F.percentile(c, p95).alias("correction_abs_q95"),
                  F.percentile(s, p50).alias("score_median"), F.percentile(s, p95).alias("score_q95")]),
        (per_frame, [F.count(F.lit(1)).alias("n_images"), F.avg("n_detections").alias("per_frame_mean"), F.median("n_detections").alias("per_frame_median"), F.max("n_detections").alias("per_frame_max")]),
        (detections, [F.count(F.lit(1)).alias("n_detections")]),
        (velocities, [F.count(F.lit(1)).alias("n_velocity_estimates"), F.median(r).alias("ratio_median"), (F.percentile(r, F.lit(0.75)) - F.percentile(r, F.lit(0.25))).alias("ratio_iqr"),
                      share((r < -0.1) | (r > 1.1), r).alias("ratio_outlier_share")]),
    )
    out = None
    for rows, wanted in aggs:
        part = rows.groupBy(*by).agg(*wanted) if by else rows.agg(*wanted)
        out = part if out is None else (out.join(part, by, "full") if by else out.join(part))
    return out


def subset_summary(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames, detections and detections a frame of each scored subset of frames (subset, frame_index); frames without a subset are left out."""
    scored = frames.where("subset is not null and subset <> 'unscored'").select("frame_index", "subset")
    counts = scored.join(rows.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n")), "frame_index", "left").fillna(0, ["n"])
    return counts.groupBy("subset").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("detections"), F.avg("n").alias("per_frame"))


def sequence_numbers(frames: DataFrame) -> DataFrame:
    """Missing and repeated numbers of a sequence: kind, number."""
    n = frames.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"))
    span = frames.agg(F.min("frame_index").alias("a"), F.max("frame_index").alias("b")).where("a is not null")
    missing = span.select(F.explode(F.sequence("a", "b")).alias("frame_index")).join(n, "frame_index", "left_anti")
    return missing.select(F.lit("missing").alias("kind"), "frame_index").unionByName(n.where("n > 1").select(F.lit("repeated").alias("kind"), "frame_index"))


def manifest_hash(files: DataFrame, name: str, content: str) -> DataFrame:
    """One row: SHA-256 over the sorted names and SHA-256 of all files, files, bytes.

    Files are hashed where they lie; names and hashes alone, in 256 parts by hash, reach one task each, then their hashes.
    """
    digest = F.sha2(F.col(content).cast("binary"), 256)
    rows = files.select(F.col(name).cast("string").alias("name"), digest.alias("sha"), F.octet_length(F.col(content).cast("binary")).alias("bytes"))
    parts = rows.groupBy(F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(256)).alias("part")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "sha"))), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    )
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n")
    return parts.agg(F.sha2(ordered, 256).alias("sha256"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def merged_evidence(labeled: DataFrame, map_only: DataFrame) -> DataFrame:
    """One row a variant of either table; where both have a column, the labelled value counts unless null."""
    both = [c for c in labeled.columns if c in map_only.columns and c != "variant"]
    other = map_only.withColumnsRenamed({c: f"_{c}" for c in both})
    out = labeled.join(other, "variant", "full")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in both}).drop(*[f"_{c}" for c in both]) if both else out


def winner(scored: DataFrame) -> DataFrame:
    """The eligible variant with the highest score, the first by name of equals."""
    key = F.struct((-F.col("ghost_objective_score")).alias("s"), "variant")
    return scored.where("eligible_for_selection").agg(F.min_by(F.struct(*scored.columns), key).alias("r")).where("r is not null").select("r.*")


def contact_rows(features: DataFrame, limit: int = 8, low: float = 0.4) -> DataFrame:
    """The rows to look at first: rejected ones, then false ones, then recurring true ones, then the rest, each by ratio."""
    rank = F.when(F.col("rejected"), 0).when(F.col("role") == "FP", 1).when((F.col("role") == "TP") & (F.col("ratio") >= low), 2).otherwise(3)
    return features.withColumn("priority", rank).orderBy("priority", F.desc("ratio"), "number").limit(limit)


def second_largest(values: Column) -> Column:
    """The second largest of an array's values; null with fewer than two."""
    return F.get(F.sort_array(F.filter(values, lambda x: x.isNotNull()), asc=False), F.lit(1))


def ordered_points(rows: DataFrame) -> DataFrame:
    return rows.where(finite(F.col("fp_per_frame")).isNotNull() & finite(F.col("recall")).isNotNull()).orderBy("fp_per_frame", "recall")


def epochs(frames: int, count: int | None = None, length: int | None = None, overlap: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(epoch, start, stop, training start, training stop) of consecutive ranges of frames."""
    length = length or -(-frames // (count or 1))
    out = []
    for i, start in enumerate(range(0, frames, length)):
        stop = min(frames, start + length)
        out.append((i, start, stop, max(0, start - overlap), min(frames, stop + overlap)))
    return out
