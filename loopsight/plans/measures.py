"""Evaluation, summaries, warnings, splits and sampling plans."""

from pyspark.sql import functions as F

from loopsight.functions import boxes, scores
from loopsight.operators import evaluation, matching, reports, splits, velocity
from loopsight.plans.common import columns, rounded
from loopsight.sources import views as v
from loopsight.sources.views import CTES


def _matches(s, d):
    return matching.mutual_best(matching.iou_pairs(v.detections(s, d), v.truth(s, d))).select("frame_index", "label", "truth_id", "iou")


def _velocities(s, d):
    return velocity.least_squares(v.tracks(s, d), 0.02)


def _areas(s, d):
    h, w = F.col("bbox_bottom") - F.col("bbox_top"), F.col("bbox_right") - F.col("bbox_left")
    return v.detections(s, d).withColumn("area_px", F.floor(h * w * 3 / 4))


def _per_frame(s, d):
    n = v.detections(s, d).groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"))
    return v.phases(s, d).select("frame_index").join(n, "frame_index", "left").select("frame_index", F.coalesce("n", F.lit(0)).alias("n_detections"))


def _phases(s, d):
    return v.phases(s, d).withColumn("loss", F.when(F.col("frame_index") % 9 > 0, 1 - F.col("score") / 2))


def detection_metrics(s, d):
    """With matches for most pairs; a frame's boxes are one array."""
    return rounded(evaluation.detection_metrics(v.detections(s, d), v.truth(s, d)))


def detection_metrics_mutual(s, d):
    frames = v.phases(s, d).where("frame_index % 3 > 0")
    matches = _matches(s, d).join(frames, "frame_index", "left_semi")
    return rounded(evaluation.detection_metrics(v.detections(s, d), v.truth(s, d), frames=frames, matches=matches))


def frame_outcomes(s, d):
    return evaluation.frame_outcomes(v.detections(s, d), v.truth(s, d), _matches(s, d), v.phases(s, d))


def detection_roles(s, d):
    return evaluation.roles(v.detections(s, d), _matches(s, d)).select("frame_index", "label", "role")


def _points(s, d):
    """Points of a score curve; several share a rate."""
    return v.table(s, d, "part").where("p_partkey <= 150").selectExpr(
        "p_partkey as threshold", "p_partkey % 40 / 16e0 as fp_per_frame", "case when p_partkey % 17 > 0 then p_partkey * 37 % 101 / 150e0 + p_partkey % 40 / 200e0 end as recall"
    )


def froc_points(s, d):
    return rounded(evaluation.monotone_points(_points(s, d)))


def froc_measures(s, d):
    p = _points(s, d)
    parts = [evaluation.recall_at(p, x).withColumnRenamed("recall", f"recall_{i}") for i, x in enumerate((0.1, 1.0))]
    return rounded(parts[0].join(parts[1]).join(evaluation.area_up_to(p, 1.0)))


def froc_thresholds(s, d):
    return rounded(evaluation.thresholds(v.detections(s, d).select(F.floor("peak_signal").alias("score")), 10))


def _tracklets(s, d):
    """Truth and detections as tracklets: boxes of one number in runs of 50 frames."""
    run = F.floor(F.col("frame_index") / 50)
    truth = v.truth(s, d).select((run * 10 + F.col("truth_id")).alias("tracklet_id"), "frame_index", "truth_id")
    found = v.detections(s, d).select((run * 10 + F.col("label") - F.col("frame_index") % 2).alias("track_id"), "frame_index", "label")
    met = _matches(s, d).join(truth, ["frame_index", "truth_id"]).join(found, ["frame_index", "label"])
    return truth, found, met.withColumn("centroid_error_px", 1 - F.col("iou"))


def tracklet_metrics(s, d):
    truth, found, matches = _tracklets(s, d)
    return rounded(evaluation.evaluate_tracklets(truth, found, matches, v.phases(s, d).where("frame_index % 2 = 0")))


def identity_switches(s, d):
    return evaluation.identity_switches(_tracklets(s, d)[2])


def tracklet_segments(s, d):
    truth, _, matches = _tracklets(s, d)
    return evaluation.fragments(truth.groupBy("tracklet_id", "frame_index").agg(F.count(F.lit(1)).alias("n")).drop("n"), matches.dropDuplicates(["tracklet_id", "frame_index"]))


def robust_scores(s, d):
    return rounded(evaluation.robust_z(v.phases(s, d), "correction_px").select("frame_index", "z"))


def stress_subsets(s, d):
    p = v.phases(s, d).withColumn("x", F.when(F.col("frame_index") % 5 > 0, F.col("score"))).withColumn("w", F.when(F.col("frame_index") % 10 > 0, F.col("correction_px")))
    return rounded(evaluation.stress_scores(p, ["x", "w"], 4).select("frame_index", "stress_score", "subset"))


def _tracked(s, d):
    return v.tracks(s, d).withColumns({
        "overlap": F.when(F.col("x") % 3 > 0, F.col("y") % 10 / 8), "probability": F.when(F.col("x") % 5 > 0, F.col("x") % 7 / 9), "peak_signal": F.col("x") / 10,
        "area_px": F.when(F.col("x") % 4 > 0, F.col("x") % 19),
    })


def artifact_evidence(s, d):
    return rounded(evaluation.artifact_evidence(_tracked(s, d)))


def velocity_scores(s, d):
    out = evaluation.score_velocities(_velocities(s, d), evaluation.artifact_evidence(_tracked(s, d)).select("track_id", "artifact_score"), 60, -0.5, 0.5, 0.4, 0.3)
    return rounded(out.select("track_id", "passes_length", "passes_ratio", "passes_lateral", "passes_artifact", "accepted", "plausibility_score"))


def accepted_velocities(s, d):
    """Rows that the gates accept."""
    return evaluation.score_velocities(_velocities(s, d), None, 60, -0.5, 0.5).where("accepted").select("track_id", "n_detections")


def bootstrap_corrections(s, d):
    values = v.phases(s, d)
    return rounded(evaluation.bootstrap(values, "correction_px", ["frame_index"], {"mean": F.avg("correction_px"), "largest": F.max("correction_px")}, 40, 3, 5))


def bootstrap_outcomes(s, d):
    return rounded(evaluation.bootstrap_outcomes(frame_outcomes(s, d), 30, 3, 4))


def confidence_interval(s, d):
    return rounded(evaluation.interval(v.phases(s, d), "correction_px", 0.9, ["revolution"]))


def detection_quality(s, d):
    return rounded(reports.detection_quality(_areas(s, d), 10, 5.0, 1.0))


def track_quality(s, d):
    return rounded(reports.track_quality(_tracked(s, d), 9.0, 60, 70))


def track_continuity(s, d):
    return rounded(reports.track_continuity(v.tracks(s, d)))


def velocity_errors(s, d):
    return rounded(reports.velocity_errors(_velocities(s, d), 0.01))


def representative_velocity(s, d):
    return rounded(reports.representative_velocity(_velocities(s, d), 0.1).select("track_id", "n_detections", "v_y", "ratio"))


def truth_matched_velocity(s, d):
    return rounded(reports.truth_matched_velocity(_velocities(s, d), 0.01, None).select("track_id", "n_detections", "v_y", "ratio"))


def track_events(s, d):
    return rounded(reports.events_of_tracks(_tracked(s, d)))


def flux(s, d):
    rows = _velocities(s, d).withColumn("accepted", F.col("n_detections") % 2 == 0)
    return rounded(reports.flux(rows, 1500, 25.0, accepted_only=True))


def physical_check(s, d):
    out = reports.physical_check(reports.events_of_tracks(_tracked(s, d)), 60.0, 0.5, 0.25, 0.1)
    return rounded(out.withColumn("warnings", F.array_join("warnings", "; ")))


def speed_consistency(s, d):
    out = reports.speed_consistency(v.phases(s, d), v.VELOCITY, 8.0)
    return rounded(out.withColumn("warnings", F.array_join("warnings", "; ")))


def drift_report(s, d):
    out = reports.drift(_per_frame(s, d), _phases(s, d))
    return rounded(out.withColumn("warnings", F.array_join("warnings", "; ")), 5)


def worst_frame_tables(s, d):
    fits = v.phases(s, d).select("frame_index", (F.col("score") * 7 % 3).alias("rmse_gray"))
    return rounded(reports.worst_frames(v.phases(s, d), _per_frame(s, d), v.detections(s, d).where("overlap > 0.6"), fits, 7))


def quality_flags(s, d):
    fits = v.phases(s, d).select("frame_index", (F.col("score") + 0.4).alias("gain"))
    return rounded(reports.quality_flags(v.phases(s, d), _per_frame(s, d), _areas(s, d), _velocities(s, d), fits, 7.0, 2.0, 10_000_000))


def quality_contract(s, d):
    return rounded(reports.quality_contract(v.phases(s, d), _per_frame(s, d), _areas(s, d), _velocities(s, d), accepted_velocities(s, d), radius=7.0, step=2.0, rejected=100))


def failure_modes(s, d):
    m = v.phases(s, d).agg(F.avg("score").alias("registration_score_median"), (F.avg("score") / 2).alias("phase_boundary_fraction"), F.lit(None).cast("double").alias("track_fragmentation"))
    return reports.failure_modes(m)


def rejection_audit(s, d):
    det = v.detections(s, d).withColumn("rejected", F.col("overlap") > 0.8)
    return reports.rejection_audit(det, evaluation.score_velocities(_velocities(s, d), None, 70, -0.2, 0.2, 0.1))


def kept_and_rejected(s, d):
    return reports.kept_and_rejected(v.detections(s, d).withColumn("rejected", F.col("overlap") > 0.8))


def metadata_differences(s, d):
    return reports.metadata_differences(v.table(s, d, "nation").withColumn("one", F.lit(1)), ["n_regionkey", "one", "n_name"])


def run_summaries(s, d):
    """By run; a run is a revolution here."""
    p = v.phases(s, d)
    by = p.select("frame_index", F.col("revolution").alias("run"))
    det, vel = v.detections(s, d).join(by, "frame_index"), _velocities(s, d).withColumn("run", F.col("track_id") % 5)
    return rounded(reports.run_summary(p.withColumnRenamed("revolution", "run"), _per_frame(s, d).join(by, "frame_index"), det, vel, ["run"]))


def subset_summary(s, d):
    return rounded(reports.subset_summary(v.detections(s, d), stress_subsets(s, d)))


def sequence_numbers(s, d):
    return reports.sequence_numbers(v.phases(s, d).where("frame_index % 7 > 0").unionByName(v.phases(s, d).where("frame_index % 50 = 1")))


def content_manifest(s, d):
    return reports.manifest_hash(v.table(s, d, "documents"), "doc_id", "text")


def _evidence(s, d):
    p = v.table(s, d, "part").where("p_partkey <= 120")
    a = p.selectExpr("concat('v', p_partkey) as variant", "p_size / 50e0 as labeled_f1", "p_partkey % 7 as fp_per_frame", "case when p_partkey % 3 > 0 then p_partkey % 9 end as n_tracks")
    b = p.where("p_partkey % 4 > 0").selectExpr("concat('v', p_partkey + 20) as variant", "p_partkey % 5 as map_only_false_detections", "0 as map_only_false_long_tracks",
        "0 as map_only_false_accepted_tracks", "p_partkey % 11 as n_tracks", "1 as small_accepted_tracks", "0.5e0 as masked_pixel_fraction", "0e0 as recurrent_artifact_fraction_from_map")
    merged = reports.merged_evidence(a, b)
    return merged.select("variant", "labeled_f1", "n_tracks", *columns(scores.variant_score()))


def merged_evidence(s, d):
    return rounded(_evidence(s, d))


def evidence_winner(s, d):
    return rounded(reports.winner(_evidence(s, d)).select("variant", "ghost_objective_score"))


def contact_rows(s, d):
    f = v.detections(s, d).where("frame_index < 200").select(
        (F.col("frame_index") * 10 + F.col("label")).alias("number"), (F.col("overlap") > 0.9).alias("rejected"), F.when(F.col("label") % 2 == 0, "TP").otherwise("FP").alias("role"), (F.col("peak_signal") / 20).alias("ratio")
    )
    return rounded(reports.contact_rows(f, 20))


def second_signals(s, d):
    g = v.detections(s, d).groupBy("frame_index").agg(F.collect_list("peak_signal").alias("all"))
    return rounded(g.select("frame_index", reports.second_largest(F.col("all")).alias("second")))


def map_epochs(s, d):
    return s.createDataFrame(reports.epochs(1000, count=7, overlap=20), "epoch long, frame_start long, frame_stop long, train_start long, train_stop long")


def revolution_split(s, d):
    chosen = v.phases(s, d).where("frame_index % 4 = 0")
    return splits.frame_rows(splits.revolution_split(v.phases(s, d), 3, 4), chosen)


def revolution_composition(s, d):
    return splits.revolution_rows(splits.revolution_split(v.phases(s, d), 3, 0, [1, 2]), v.phases(s, d).where("frame_index % 4 = 0"))


def split_rates(s, d):
    items = v.detections(s, d).select("frame_index", F.col("label").alias("item"), "overlap")
    return rounded(splits.split_rates(splits.revolution_split(v.phases(s, d)), items, [F.avg("overlap").alias("mean_overlap")]))


def frame_sets(s, d):
    scored, labelled = v.phases(s, d).where("frame_index % 3 = 0"), v.truth(s, d).where("frame_index % 2 = 0")
    parts = {"scored": splits.scored_frames(scored, labelled), "empty": splits.empty_frames(scored, labelled), "labelled": splits.labelled_frames(labelled)}
    out = None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("part"), "frame_index")
        out = part if out is None else out.unionByName(part)
    return out


def frame_denominator(s, d):
    return evaluation.frame_denominator(v.detections(s, d).where("label = 7"), v.phases(s, d).where("frame_index % 3 = 0"))


def parsed_indices(s, d):
    rows = v.table(s, d, "nation").selectExpr("n_nationkey", "concat(n_nationkey, ', 3-', n_nationkey + 4, ',5,') as text")
    return rows.select("n_nationkey", F.array_join(splits.parse_indices(F.col("text")), ",").alias("numbers"))


def map_frame_plan(s, d):
    return rounded(splits.frame_plan(v.phases(s, d), _per_frame(s, d).where("frame_index % 5 > 0"), v.phases(s, d).where("frame_index % 6 > 0"), "predicted_phase_px", v.PERIOD, 100))


def velocity_subset(s, d):
    from loopsight.operators import agreement

    rows = velocity.track_extents(v.tracks(s, d)).select("track_id", "frame_start", F.when(F.col("track_id") % 3 > 0, F.col("frame_end")).alias("frame_end"))
    return agreement.velocities_in(rows, v.phases(s, d).where("frame_index % 2 = 0 and frame_index < 600"))


def audited_boxes(s, d):
    a = boxes.sides("bbox_")
    return matching.audit_boxes(v.detections(s, d).where(boxes.area(a) > 0), v.HEIGHT, v.WIDTH, 5, 3, 3.0)


QUERIES = {
    f.__name__: f
    for f in (
        detection_metrics, detection_metrics_mutual, frame_outcomes, detection_roles, froc_points, froc_measures, froc_thresholds, tracklet_metrics,
        identity_switches, tracklet_segments, robust_scores, stress_subsets, artifact_evidence, velocity_scores, accepted_velocities, bootstrap_corrections,
        bootstrap_outcomes, confidence_interval, detection_quality, track_quality, track_continuity, velocity_errors, representative_velocity,
        truth_matched_velocity, track_events, flux, physical_check, speed_consistency, drift_report, worst_frame_tables, quality_flags, quality_contract,
        failure_modes, rejection_audit, kept_and_rejected, metadata_differences, run_summaries, subset_summary, sequence_numbers, content_manifest,
        merged_evidence, evidence_winner, contact_rows, second_signals, map_epochs, revolution_split, revolution_composition, split_rates, frame_sets,
        frame_denominator, parsed_indices, map_frame_plan, velocity_subset, audited_boxes,
    )
}

_OUT = """, n AS (SELECT p.frame_index, (SELECT count(*) FROM detections d WHERE d.frame_index = p.frame_index) AS nd,
    (SELECT count(*) FROM truth t WHERE t.frame_index = p.frame_index) AS nt, (SELECT count(*) FROM best b WHERE b.frame_index = p.frame_index) AS tp FROM phases p)
"""
_VEL = """, vel AS (SELECT track_id, count(*) AS n, regr_slope(y, frame_index) AS v_y, regr_slope(x, frame_index) AS v_x FROM tracks GROUP BY 1),
  ve AS (SELECT *, v_y / 0.02e0 AS ratio, sqrt(v_y * v_y + v_x * v_x) AS speed FROM vel)
"""
_PER = ", per_frame AS (SELECT p.frame_index, count(d.label) AS n FROM phases p LEFT JOIN detections d USING (frame_index) GROUP BY 1)\n"
_AREA = ", ar AS (SELECT *, floor((bbox_bottom - bbox_top) * (bbox_right - bbox_left) * 3 / 4) AS a FROM detections)\n"
_POINTS = """WITH p AS (SELECT p_partkey % 40 / 16e0 AS f, CASE WHEN p_partkey % 17 > 0 THEN p_partkey * 37 % 101 / 150e0 + p_partkey % 40 / 200e0 END AS r
    FROM part WHERE p_partkey <= 150),
  b AS (SELECT f, max(r) AS r FROM p WHERE r IS NOT NULL GROUP BY 1), m AS (SELECT f, max(r) OVER (ORDER BY f) AS r FROM b)
"""
_TRACKLETS = """, tt AS (SELECT floor(frame_index / 50) * 10 + truth_id AS tracklet_id, frame_index, truth_id FROM truth),
  tf AS (SELECT floor(frame_index / 50) * 10 + label - frame_index % 2 AS track_id, frame_index, label FROM detections),
  ma AS (SELECT CAST(tracklet_id AS BIGINT) AS tracklet_id, CAST(track_id AS BIGINT) AS track_id, frame_index, iou
    FROM best JOIN tt USING (frame_index, truth_id) JOIN tf USING (frame_index, label))
"""
_TRACKED = """, tr AS (SELECT *, CASE WHEN x % 3 > 0 THEN y % 10 / 8 END AS overlap, CASE WHEN x % 5 > 0 THEN x % 7 / 9 END AS probability, x / 10 AS peak_signal,
    CASE WHEN x % 4 > 0 THEN x % 19 END AS area_px FROM tracks),
  ev AS (SELECT track_id, count(m) AS n, avg(o) AS mo, max(o) AS xo, avg(p) AS mp, max(p) AS xp, avg(m) AS mm, count(*) FILTER (m >= 0.3e0) AS h FROM (
    SELECT track_id, least(greatest(overlap, 0), 1) AS o0, CASE WHEN overlap IS NOT NULL THEN least(greatest(overlap, 0), 1) END AS o,
      CASE WHEN probability IS NOT NULL THEN least(greatest(probability, 0), 1) END AS p, CASE WHEN overlap IS NULL AND probability IS NULL THEN NULL
        ELSE greatest(least(greatest(coalesce(overlap, 0), 0), 1), least(greatest(coalesce(probability, 0), 0), 1)) END AS m FROM tr) GROUP BY 1),
  sc AS (SELECT *, CASE WHEN n > 0 THEN h / n ELSE 0e0 END AS hf, coalesce(mm, 0) * CASE WHEN n > 0 THEN h / n ELSE 0e0 END AS score FROM ev)
"""
_EVENTS = """, e AS (SELECT track_id, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS n_observations, median(y) AS y, median(x) AS x,
    median(peak_signal) AS peak_signal_median, regr_slope(y, frame_index) AS v_y, regr_slope(x, frame_index) AS v_x FROM tr GROUP BY 1)
"""
_Z = """, zx AS (SELECT frame_index, CASE WHEN frame_index % 5 > 0 THEN score END AS x, CASE WHEN frame_index % 10 > 0 THEN correction_px END AS w FROM phases),
  mx AS (SELECT median(x) AS a, median(w) AS b FROM zx), dx AS (SELECT median(abs(x - a)) * 1.4826e0 AS s, median(abs(w - b)) * 1.4826e0 AS t FROM zx, mx),
  zz AS (SELECT frame_index, CASE WHEN x IS NOT NULL THEN least(greatest((x - a) / s, -5), 5) END AS zx, CASE WHEN w IS NOT NULL THEN least(greatest((w - b) / t, -5), 5) END AS zw
    FROM zx, mx, dx),
  st AS (SELECT frame_index, CASE WHEN zx IS NULL THEN zw WHEN zw IS NULL THEN zx ELSE (zx + zw) / 2 END AS score FROM zz),
  su AS (SELECT *, 'Q' || (least(floor((row_number() OVER (ORDER BY score, frame_index) - 1) * 4 / (SELECT count(score) FROM st)), 3) + 1)::INT AS subset FROM st WHERE score IS NOT NULL
    UNION ALL SELECT *, 'unscored' FROM st WHERE score IS NULL)
"""


def _spread(x: str, prefix: str, low: str = "q25", high: str = "q75", a: float = 0.25, b: float = 0.75) -> str:
    return f"""count({x}) AS {prefix}count, round(avg({x}), 6) AS {prefix}mean, round(median({x}), 6) AS {prefix}median, round(CAST(min({x}) AS DOUBLE), 6) AS {prefix}min,
      round(CAST(max({x}) AS DOUBLE), 6) AS {prefix}max, round(quantile_cont(CAST({x} AS DOUBLE), {a}), 6) AS {prefix}{low}, round(quantile_cont(CAST({x} AS DOUBLE), {b}), 6) AS {prefix}{high}"""


def _wide(x: str, prefix: str) -> str:
    return _spread(x, prefix, "p05", "p95", 0.05, 0.95)


ORACLE_SQL = {
    "detection_metrics_mutual": CTES
    + _OUT
    + """, o AS (SELECT sum(tp) AS tp, sum(nd - tp) AS fp, sum(nt - tp) AS fn FROM n WHERE frame_index % 3 > 0),
      e AS (SELECT avg(iou) AS i, avg(sqrt(((bbox_top + bbox_bottom) / 2 - (t_top + t_bottom) / 2) ** 2 + ((bbox_left + bbox_right) / 2 - (t_left + t_right) / 2) ** 2)) AS c
        FROM best WHERE frame_index % 3 > 0 AND frame_index IN (SELECT frame_index FROM phases))
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
      round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(i, 6) AS mean_iou, round(c, 6) AS mean_centroid_error_px FROM o, e""",
    "frame_outcomes": CTES + _OUT + "SELECT frame_index, tp, nd - tp AS fp, nt - tp AS fn FROM n",
    "detection_roles": CTES + "SELECT d.frame_index, d.label, CASE WHEN b.label IS NULL THEN 'FP' ELSE 'TP' END AS role FROM detections d LEFT JOIN best b USING (frame_index, label)",
    "froc_points": _POINTS + "SELECT f AS fp_per_frame, round(r, 6) AS recall FROM m",
    "froc_measures": _POINTS
    + """, c AS (SELECT f, max(r) AS r FROM (SELECT 0e0 AS f, 0e0 AS r UNION ALL SELECT f, r FROM m WHERE f <= 1) GROUP BY 1),
      l AS (SELECT (coalesce(lead(f) OVER w, 1e0) - f) * (r + coalesce(lead(r) OVER w, r)) / 2 AS a FROM c WINDOW w AS (ORDER BY f))
    SELECT round(coalesce((SELECT max(r) FROM m WHERE f <= 0.1e0), 0), 6) AS recall_0, round(coalesce((SELECT max(r) FROM m WHERE f <= 1), 0), 6) AS recall_1,
      round((SELECT sum(a) FROM l), 6) AS area""",
    "froc_thresholds": CTES
    + """, u AS (SELECT DISTINCT floor(peak_signal) AS threshold FROM detections), r AS (SELECT *, row_number() OVER (ORDER BY threshold DESC) - 1 AS i, count(*) OVER () AS n FROM u)
    SELECT threshold FROM r WHERE n <= 10 OR i < 5 OR i IN (SELECT round_even(5 + (n - 1 - 5) * k / 4.0e0, 0) FROM range(5) t(k))""",
    "tracklet_metrics": CTES
    + _TRACKLETS
    + """, sf AS (SELECT frame_index FROM phases WHERE frame_index % 2 = 0 UNION SELECT frame_index FROM truth),
      pr AS (SELECT * FROM tf WHERE frame_index IN (SELECT frame_index FROM sf)),
      nt AS (SELECT tracklet_id, count(*) AS nt FROM tt GROUP BY 1), np AS (SELECT track_id, count(*) AS np FROM pr GROUP BY 1),
      pa AS (SELECT tracklet_id, track_id, count(*) AS c FROM ma GROUP BY 1, 2),
      aa AS (SELECT sum(c * c / (nt + np - c)) / sum(c) AS ass_a, sum(c * c / np) / sum(c) AS ass_pr, sum(c * c / nt) / sum(c) AS ass_re FROM pa JOIN nt USING (tracklet_id) JOIN np USING (track_id)),
      mg AS (SELECT track_id, count(*) AS k, max(c) AS best FROM pa GROUP BY 1), sp AS (SELECT tracklet_id, count(*) AS k, sum(c) AS hits FROM pa GROUP BY 1),
      sw AS (SELECT tracklet_id, CASE WHEN track_id <> lag(track_id) OVER (PARTITION BY tracklet_id ORDER BY frame_index) THEN 1 ELSE 0 END AS ch FROM ma),
      sg AS (SELECT t.tracklet_id, m.frame_index IS NOT NULL AS hit, t.frame_index FROM tt t LEFT JOIN ma m ON m.tracklet_id = t.tracklet_id AND m.frame_index = t.frame_index),
      sb AS (SELECT tracklet_id, CASE WHEN hit AND NOT coalesce(lag(hit) OVER (PARTITION BY tracklet_id ORDER BY frame_index), false) THEN 1 ELSE 0 END AS b FROM sg),
      se AS (SELECT tracklet_id, sum(b) AS s FROM sb GROUP BY 1),
      z AS (SELECT (SELECT count(*) FROM ma) AS tp, (SELECT count(*) FROM tt) AS t, (SELECT count(*) FROM pr) AS p, (SELECT count(*) FROM sf) AS f, (SELECT count(DISTINCT tracklet_id) FROM tt) AS td,
        (SELECT count(DISTINCT track_id) FROM pr) AS pd, (SELECT count(DISTINCT tracklet_id) FROM ma) AS mt, (SELECT count(DISTINCT track_id) FROM ma) AS mp)
    SELECT tp AS true_positives, round((SELECT avg(iou) FROM ma), 6) AS loc_a, round((SELECT avg(1 - iou) FROM ma), 6) AS mean_centroid_error_px, mt AS matched_truth_tracklets,
      mp AS matched_predicted_tracklets, t AS truth_boxes, td AS truth_tracklets, p AS predicted_boxes, pd AS predicted_tracklets, f AS scored_frames,
      (SELECT count(*) FROM pr WHERE frame_index NOT IN (SELECT frame_index FROM truth)) AS false_positives_on_empty_scored_frames,
      round(ass_a, 6) AS ass_a, round(ass_pr, 6) AS ass_pr, round(ass_re, 6) AS ass_re,
      round((SELECT avg(coalesce(best, 0) / np) FROM np LEFT JOIN mg USING (track_id)), 6) AS mean_predicted_tracklet_purity, (SELECT count(*) FROM mg WHERE k > 1) AS merged_prediction_tracklets,
      round((SELECT avg(coalesce(hits, 0) / nt) FROM nt LEFT JOIN sp USING (tracklet_id)), 6) AS mean_truth_tracklet_frame_coverage, (SELECT count(*) FROM sp WHERE k > 1) AS split_truth_tracklets,
      CAST((SELECT sum(ch) FROM sw) AS BIGINT) AS identity_switches, (SELECT count(DISTINCT tracklet_id) FROM sw WHERE ch = 1) AS tracklets_with_id_switch,
      (SELECT count(*) FROM se WHERE s > 1) AS fragmented_truth_tracklets, CAST((SELECT sum(greatest(s - 1, 0)) FROM se) AS BIGINT) AS extra_truth_fragments,
      p - tp AS false_positives, t - tp AS false_negatives, round(tp / p, 6) AS precision, round(tp / t, 6) AS recall, round(2 * tp / (p + t), 6) AS f1,
      round(tp / (p + t - tp), 6) AS det_a, pd - mp AS false_positive_tracklets, td - mt AS false_negative_tracklets, round(mp / pd, 6) AS tracklet_precision, round(mt / td, 6) AS tracklet_recall,
      round((p - tp) / f, 6) AS false_positives_per_scored_frame, round(sqrt(tp / (p + t - tp) * ass_a), 6) AS hota FROM z, aa""",
    "identity_switches": CTES
    + _TRACKLETS
    + """SELECT tracklet_id, CAST(sum(ch) AS BIGINT) AS switches FROM (
      SELECT tracklet_id, CASE WHEN track_id <> lag(track_id) OVER (PARTITION BY tracklet_id ORDER BY frame_index) THEN 1 ELSE 0 END AS ch FROM ma) GROUP BY 1""",
    "tracklet_segments": CTES
    + _TRACKLETS
    + """, sg AS (SELECT CAST(t.tracklet_id AS BIGINT) AS tracklet_id, t.frame_index, m.frame_index IS NOT NULL AS hit FROM (SELECT DISTINCT tracklet_id, frame_index FROM tt) t
        LEFT JOIN (SELECT DISTINCT tracklet_id, frame_index FROM ma) m ON m.tracklet_id = t.tracklet_id AND m.frame_index = t.frame_index)
    SELECT tracklet_id, CAST(sum(b) AS BIGINT) AS segments FROM (
      SELECT tracklet_id, CASE WHEN hit AND NOT coalesce(lag(hit) OVER (PARTITION BY tracklet_id ORDER BY frame_index), false) THEN 1 ELSE 0 END AS b FROM sg) GROUP BY 1""",
    "robust_scores": CTES
    + """, m AS (SELECT median(correction_px) AS m FROM phases), d AS (SELECT median(abs(correction_px - m)) * 1.4826e0 AS s FROM phases, m)
    SELECT frame_index, round(least(greatest((correction_px - m) / s, -5), 5), 6) AS z FROM phases, m, d""",
    "stress_subsets": CTES + _Z + "SELECT frame_index, round(score, 6) AS stress_score, subset FROM su",
    "artifact_evidence": CTES
    + _TRACKED
    + """SELECT track_id, n AS n_scored, round(mo, 6) AS mean_overlap, round(xo, 6) AS max_overlap, round(mp, 6) AS mean_probability, round(xp, 6) AS max_probability,
      round(hf, 6) AS hit_fraction, round(score, 6) AS artifact_score FROM sc""",
    "velocity_scores": CTES
    + _VEL
    + _TRACKED
    + """, g AS (SELECT ve.*, s.score, greatest(-0.5e0 - ratio, ratio - 0.5e0, 0e0) AS off FROM ve JOIN sc s USING (track_id))
    SELECT track_id, n >= 60 AS passes_length, ratio BETWEEN -0.5e0 AND 0.5e0 AS passes_ratio, abs(v_x) <= 0.4e0 AS passes_lateral, score <= 0.3e0 AS passes_artifact,
      n >= 60 AND ratio BETWEEN -0.5e0 AND 0.5e0 AND abs(v_x) <= 0.4e0 AND score <= 0.3e0 AS accepted,
      round(least(1e0, n / 60e0) * greatest(0, 1 - off) * greatest(0, 1 - abs(v_x) / 0.4e0) * greatest(0, 1 - score), 6) AS plausibility_score FROM g""",
    "accepted_velocities": CTES + _VEL + "SELECT track_id, n AS n_detections FROM ve WHERE n >= 60 AND ratio BETWEEN -0.5e0 AND 0.5e0",
    "confidence_interval": CTES
    + """SELECT revolution, round(median(correction_px), 6) AS correction_px_bootstrap_median, round(quantile_cont(correction_px, 0.05), 6) AS correction_px_ci_low,
      round(quantile_cont(correction_px, 0.95), 6) AS correction_px_ci_high FROM phases GROUP BY 1""",
    "detection_quality": CTES
    + _AREA
    + f"""SELECT count(*) FILTER (a < 10) AS small_detections, round(avg(CASE WHEN a < 10 THEN 1e0 ELSE 0e0 END), 6) AS small_share,
      count(*) FILTER (peak_signal BETWEEN 5 AND 6) AS near_threshold, round(avg(CASE WHEN peak_signal BETWEEN 5 AND 6 THEN 1e0 ELSE 0e0 END), 6) AS near_threshold_share,
      {_spread('a', 'area_')}, {_spread('peak_signal', 'peak_')} FROM ar""",
    "track_quality": CTES
    + _TRACKED
    + f"""SELECT CAST(sum(n) AS BIGINT) AS track_rows, count(*) AS tracks, count(m) AS tracks_with_area, count(*) FILTER (m < 9) AS small_tracks, round(count(*) FILTER (m < 9) / count(m), 6) AS small_share,
      count(*) FILTER (m < 9 AND n >= 60) AS long_small_tracks, count(*) FILTER (m < 9 AND n >= 70) AS very_long_small_tracks,
      {_spread('n', 'length_')}, {_spread('m', 'mean_area_')}, {_spread('d', 'median_area_')} FROM (
      SELECT track_id, count(*) AS n, avg(area_px) AS m, median(area_px) AS d FROM tr GROUP BY 1)""",
    "track_continuity": CTES
    + """SELECT CAST(sum(n) AS BIGINT) AS track_rows, count(*) AS tracks, round(avg(n), 6) AS mean_track_length, round(median(n), 6) AS median_track_length, max(n) AS max_track_length,
      count(*) FILTER (n = 1) AS single_frame_tracks, round(avg(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END), 6) AS single_frame_share, round(avg(s), 6) AS mean_span, round(median(s), 6) AS median_span
    FROM (SELECT count(*) AS n, max(frame_index) - min(frame_index) + 1 AS s FROM tracks GROUP BY track_id)""",
    "velocity_errors": CTES
    + _VEL
    + """SELECT count(v_y) AS n, round(avg(v_y), 6) AS mean, round(var_pop(v_y), 6) AS variance, round(avg(abs(v_y - 0.01e0)), 6) AS mean_abs_error, round(avg(v_y - 0.01e0), 6) AS bias,
      round(stddev_pop(v_y - 0.01e0), 6) AS error_std, round(var_pop(v_y - 0.01e0), 6) AS error_variance FROM ve""",
    "representative_velocity": CTES + _VEL + "SELECT track_id, n AS n_detections, round(v_y, 6) AS v_y, round(ratio, 6) AS ratio FROM ve ORDER BY n DESC, abs(ratio - 0.1e0), track_id LIMIT 1",
    "truth_matched_velocity": CTES + _VEL + "SELECT track_id, n AS n_detections, round(v_y, 6) AS v_y, round(ratio, 6) AS ratio FROM ve ORDER BY abs(v_y - 0.01e0), n DESC, track_id LIMIT 1",
    "track_events": CTES
    + _TRACKED
    + _EVENTS
    + """SELECT track_id, first_frame, last_frame, n_observations, round(y, 6) AS y, round(x, 6) AS x, round(peak_signal_median, 6) AS peak_signal_median, round(v_y, 6) AS v_y,
      round(v_x, 6) AS v_x FROM e""",
    "flux": CTES
    + _VEL
    + """SELECT (SELECT count(*) FROM ve) AS n_velocity_rows, count(*) AS n_accepted_rows, 60e0 AS duration_s, round(count(*) / 60e0, 6) AS particle_flux_per_s, round(median(ratio), 6) AS median_ratio,
      round(quantile_cont(ratio, 0.25), 6) AS q25_ratio, round(quantile_cont(ratio, 0.75), 6) AS q75_ratio, round(avg(v_y) * 25, 6) AS mean_velocity_px_per_s, round(median(speed), 6) AS median_speed
    FROM ve WHERE n % 2 = 0""",
    "physical_check": CTES
    + """, n AS (SELECT count(DISTINCT track_id) AS event_count FROM tracks), f AS (SELECT *, event_count / 60e0 AS f FROM n)
    SELECT event_count, round(f, 6) AS particle_flux_per_s, round(f * 0.25e0, 6) AS mass_flux_g_s, round((f - 0.5e0) / 0.5e0, 6) AS flux_error, round((f * 0.25e0 - 0.1e0) / 0.1e0, 6) AS mass_error,
      concat_ws('; ', CASE WHEN abs((f - 0.5e0) / 0.5e0) > 0.25e0 THEN 'image-derived particle flux differs from expected flux by more than 25%' END,
        CASE WHEN abs((f * 0.25e0 - 0.1e0) / 0.1e0) > 0.25e0 THEN 'estimated mass flux differs from expected mass flux by more than 25%' END) AS warnings FROM f""",
    "speed_consistency": CTES
    + f""", q AS (SELECT count(*) AS phase_rows, regr_slope(correction_px, frame_index) AS k, count(*) FILTER (abs(correction_px) = 8) AS boundary_hits, {_wide('score', 'score_')} FROM phases)
    SELECT * EXCLUDE (k), round(k, 6) AS slope, round(59.25e0 - k, 6) AS inferred_velocity,
      concat_ws('; ', CASE WHEN abs(k) > 0.05e0 THEN 'phase corrections show a non-trivial linear trend; supplied belt velocity may be biased' END,
        CASE WHEN boundary_hits > 0.05e0 * phase_rows THEN 'more than 5% of registration corrections hit the search boundary' END,
        CASE WHEN score_median < 0.1e0 THEN 'median registration score is low' END) AS warnings FROM q""",
    "drift_report": CTES
    + _PER
    + f""", ls AS (SELECT *, CASE WHEN frame_index % 9 > 0 THEN 1 - score / 2 END AS loss FROM phases),
      q AS (SELECT regr_slope(n, frame_index) AS a, {_wide('n', 'detections_')} FROM per_frame),
      r AS (SELECT regr_slope(correction_px, frame_index) AS b, regr_slope(loss, frame_index) AS c, {_wide('correction_px', 'correction_')}, {_wide('loss', 'loss_')} FROM ls)
    SELECT * EXCLUDE (a, b, c), round(a, 5) AS detection_slope, round(b, 5) AS correction_slope, round(c, 5) AS loss_slope,
      concat_ws('; ', CASE WHEN abs(a) > 0.01e0 THEN 'detection counts drift over time; check contamination, illumination drift, or threshold stability' END,
        CASE WHEN c > 0 THEN 'registration loss increases over time; consider multi-epoch maps or illumination correction' END,
        CASE WHEN abs(b) > 0.05e0 THEN 'phase correction drift suggests speed or timing mismatch' END) AS warnings FROM q, r""".replace(", 6) AS", ", 5) AS"),
    "worst_frame_tables": CTES
    + _PER
    + """, rj AS (SELECT frame_index, count(*) AS v FROM detections WHERE overlap > 0.6e0 GROUP BY 1)
    (SELECT 'low_registration_score' AS bucket, frame_index, round(score, 6) AS value FROM phases ORDER BY score, frame_index LIMIT 7)
    UNION ALL (SELECT 'large_phase_correction', frame_index, abs(correction_px) AS v FROM phases ORDER BY v DESC, frame_index LIMIT 7)
    UNION ALL (SELECT 'detection_spikes', frame_index, CAST(n AS DOUBLE) FROM per_frame ORDER BY n DESC, frame_index LIMIT 7)
    UNION ALL (SELECT 'empty_or_low_detection_frames', frame_index, CAST(n AS DOUBLE) FROM per_frame ORDER BY n, frame_index LIMIT 7)
    UNION ALL (SELECT 'recurrent_rejections', frame_index, CAST(v AS DOUBLE) FROM rj ORDER BY v DESC, frame_index LIMIT 7)
    UNION ALL (SELECT 'photometric_rmse', frame_index, round(score * 7 % 3, 6) FROM phases ORDER BY score * 7 % 3 DESC, frame_index LIMIT 7)""",
    "quality_flags": CTES
    + _PER
    + _AREA
    + _VEL
    + """, m AS (SELECT (SELECT avg(CASE WHEN abs(abs(correction_px) - 7) <= 1 THEN 1e0 ELSE 0e0 END) FROM phases) AS b, (SELECT quantile_cont(n, 0.95) FROM per_frame) AS p, (SELECT median(n) FROM per_frame) AS d,
        (SELECT avg(CASE WHEN a <= 2 THEN 1e0 ELSE 0e0 END) FROM ar) AS t, (SELECT 10000000 / (10000000 + count(*)) FROM ar) AS j, (SELECT avg(CASE WHEN ratio BETWEEN 0 AND 1.1e0 THEN 1e0 ELSE 0e0 END) FROM ve) AS i,
        (SELECT avg(CASE WHEN score + 0.4e0 < 0.75e0 OR score + 0.4e0 > 1.25e0 THEN 1e0 ELSE 0e0 END) FROM phases) AS g)
    SELECT * FROM (
      SELECT 'warning' AS severity, 'registration_boundary' AS code, round(b, 6) AS value, 0.05e0 AS "limit" FROM m WHERE b > 0.05e0
      UNION ALL SELECT 'warning', 'detection_spikes', round(p, 6), greatest(25e0, 5 * (d + 1)) FROM m WHERE p > greatest(25e0, 5 * (d + 1))
      UNION ALL SELECT 'warning', 'many_tiny_components', round(t, 6), 0.5e0 FROM m WHERE t > 0.5e0
      UNION ALL SELECT 'warning', 'implausible_velocity_ratios', round(i, 6), 0.5e0 FROM m WHERE i < 0.5e0
      UNION ALL SELECT 'info', 'heavy_recurrent_filtering', round(j, 6), 0.75e0 FROM m WHERE j > 0.75e0
      UNION ALL SELECT 'warning', 'photometric_gain_drift', round(g, 6), 0.1e0 FROM m WHERE g > 0.1e0)""",
    "quality_contract": CTES
    + _AREA
    + _VEL
    + """, m AS (SELECT (SELECT avg(CASE WHEN abs(abs(correction_px) - 7) <= 1 THEN 1e0 ELSE 0e0 END) FROM phases) AS b, (SELECT avg(CASE WHEN a <= 2 THEN 1e0 ELSE 0e0 END) FROM ar) AS t,
        (SELECT 100 / (100 + count(*)) FROM ar) AS j, (SELECT avg(CASE WHEN ratio BETWEEN 0 AND 1.1e0 THEN 1e0 ELSE 0e0 END) FROM ve) AS i,
        (SELECT CAST(count(*) AS DOUBLE) FROM ve WHERE n >= 60 AND ratio BETWEEN -0.5e0 AND 0.5e0) AS k)
    SELECT 'registration_boundary_share' AS name, b <= 0.05e0 AS passed, round(b, 6) AS value, 0.05e0 AS "limit" FROM m
    UNION ALL SELECT 'many_tiny_component_share', t <= 0.5e0, round(t, 6), 0.5e0 FROM m UNION ALL SELECT 'velocity_ratio_in_range_share', i >= 0.5e0, round(i, 6), 0.5e0 FROM m
    UNION ALL SELECT 'recurrent_rejection_share', j <= 0.75e0, round(j, 6), 0.75e0 FROM m UNION ALL SELECT 'filtered_velocity_estimates', k >= 1, round(k, 6), 1e0 FROM m""",
    "failure_modes": CTES
    + """, a AS (SELECT avg(score) AS s FROM phases)
    SELECT 'registration-search-boundary' AS code, 'high' AS severity FROM a WHERE s / 2 > 0.1e0 UNION ALL SELECT 'low-registration-score', 'high' FROM a WHERE s < 0.2e0""",
    "rejection_audit": CTES
    + _VEL
    + """SELECT 'detections' AS source, frame_index, CAST(NULL AS BIGINT) AS track_id, 'recurrent_artifact' AS reason_rejected, true AS failed_artifact_gate, false AS failed_track_gate,
      false AS failed_velocity_gate FROM detections WHERE overlap > 0.8e0
    UNION ALL SELECT 'tracks', NULL, track_id, concat_ws('+', CASE WHEN n < 70 THEN 'track_length' END, CASE WHEN ratio NOT BETWEEN -0.2e0 AND 0.2e0 THEN 'velocity_ratio' END,
        CASE WHEN abs(v_x) > 0.1e0 THEN 'lateral_velocity' END), false, n < 70, ratio NOT BETWEEN -0.2e0 AND 0.2e0 OR abs(v_x) > 0.1e0 FROM ve
      WHERE NOT (n >= 70 AND ratio BETWEEN -0.2e0 AND 0.2e0 AND abs(v_x) <= 0.1e0)""",
    "kept_and_rejected": CTES + 'SELECT count(*) AS "rows", count(*) FILTER (overlap > 0.8e0) AS rejected, count(*) FILTER (overlap <= 0.8e0) AS kept FROM detections',
    "metadata_differences": "SELECT 'n_regionkey' AS key, count(DISTINCT n_regionkey) AS n FROM nation UNION ALL SELECT 'n_name', count(DISTINCT n_name) FROM nation",
    "run_summaries": CTES
    + _PER
    + _VEL
    + """, a AS (SELECT revolution AS run, count(*) AS n_phase_estimates, round(median(abs(correction_px)), 6) AS correction_abs_median, round(quantile_cont(abs(correction_px), 0.95), 6) AS correction_abs_q95,
        round(median(score), 6) AS score_median, round(quantile_cont(score, 0.95), 6) AS score_q95 FROM phases GROUP BY 1),
      b AS (SELECT revolution AS run, count(*) AS n_images, round(avg(n), 6) AS per_frame_mean, round(median(n), 6) AS per_frame_median, max(n) AS per_frame_max FROM per_frame JOIN phases USING (frame_index) GROUP BY 1),
      c AS (SELECT revolution AS run, count(*) AS n_detections FROM detections JOIN phases USING (frame_index) GROUP BY 1),
      d AS (SELECT track_id % 5 AS run, count(*) AS n_velocity_estimates, round(median(ratio), 6) AS ratio_median, round(quantile_cont(ratio, 0.75) - quantile_cont(ratio, 0.25), 6) AS ratio_iqr,
        round(avg(CASE WHEN ratio < -0.1e0 OR ratio > 1.1e0 THEN 1e0 ELSE 0e0 END), 6) AS ratio_outlier_share FROM ve GROUP BY 1)
    SELECT * FROM a FULL JOIN b USING (run) FULL JOIN c USING (run) FULL JOIN d USING (run)""",
    "subset_summary": CTES
    + _Z
    + """, n AS (SELECT frame_index, subset, (SELECT count(*) FROM detections d WHERE d.frame_index = su.frame_index) AS n FROM su WHERE subset <> 'unscored')
    SELECT subset, count(*) AS frames, CAST(sum(n) AS BIGINT) AS detections, round(avg(n), 6) AS per_frame FROM n GROUP BY 1""",
    "sequence_numbers": CTES
    + """, s AS (SELECT frame_index FROM phases WHERE frame_index % 7 > 0 UNION ALL SELECT frame_index FROM phases WHERE frame_index % 50 = 1)
    SELECT 'missing' AS kind, f AS frame_index FROM (SELECT unnest(generate_series(min(frame_index), max(frame_index))) AS f FROM s) WHERE f NOT IN (SELECT frame_index FROM s)
    UNION ALL SELECT 'repeated', frame_index FROM s GROUP BY frame_index HAVING count(*) > 1""",
    "merged_evidence": "",
    "evidence_winner": "",
    "contact_rows": CTES
    + """, f AS (SELECT frame_index * 10 + label AS number, overlap > 0.9e0 AS rejected, CASE WHEN label % 2 = 0 THEN 'TP' ELSE 'FP' END AS role, peak_signal / 20 AS ratio FROM detections WHERE frame_index < 200)
    SELECT number, rejected, role, round(ratio, 6) AS ratio, CASE WHEN rejected THEN 0 WHEN role = 'FP' THEN 1 WHEN ratio >= 0.4e0 THEN 2 ELSE 3 END AS priority FROM f
    ORDER BY priority, f.ratio DESC, number LIMIT 20""",
    "second_signals": CTES
    + """, r AS (SELECT frame_index, peak_signal, row_number() OVER (PARTITION BY frame_index ORDER BY peak_signal DESC) AS n FROM detections)
    SELECT frame_index, round(max(CASE WHEN n = 2 THEN peak_signal END), 6) AS second FROM r GROUP BY 1""",
    "map_epochs": """SELECT i AS epoch, i * 143 AS frame_start, least(1000, (i + 1) * 143) AS frame_stop, greatest(0, i * 143 - 20) AS train_start, least(1000, least(1000, (i + 1) * 143) + 20) AS train_stop
      FROM range(7) t(i)""",
    "revolution_split": CTES
    + """, r AS (SELECT revolution, row_number() OVER (ORDER BY revolution) - 1 AS o FROM (SELECT DISTINCT revolution FROM phases))
    SELECT frame_index, revolution, CASE WHEN o % 3 = 1 THEN 'eval' ELSE 'train' END AS split, frame_index % 4 = 0 AND o % 3 <> 1 AS selected FROM phases JOIN r USING (revolution)""",
    "revolution_composition": CTES
    + """SELECT revolution, CASE WHEN revolution IN (1, 2) THEN 'eval' ELSE 'train' END AS split, count(*) AS n_frames,
      count(*) FILTER (frame_index % 4 = 0 AND revolution NOT IN (1, 2)) AS n_selected FROM phases GROUP BY 1, 2""",
    "split_rates": CTES
    + """, r AS (SELECT revolution, row_number() OVER (ORDER BY revolution) - 1 AS o FROM (SELECT DISTINCT revolution FROM phases)),
      j AS (SELECT p.frame_index, p.revolution, CASE WHEN o % 3 = 0 THEN 'eval' ELSE 'train' END AS split, label, overlap FROM phases p JOIN r USING (revolution) LEFT JOIN detections USING (frame_index))
    SELECT split, revolution, CAST(grouping(revolution) AS TINYINT) AS whole, count(DISTINCT frame_index) AS frames, count(label) AS n, round(avg(overlap), 6) AS mean_overlap,
      round(count(label) / count(DISTINCT frame_index), 6) AS per_frame FROM j GROUP BY GROUPING SETS ((split), (split, revolution))""",
    "frame_sets": CTES
    + """, s AS (SELECT frame_index FROM phases WHERE frame_index % 3 = 0), l AS (SELECT DISTINCT frame_index FROM truth WHERE frame_index % 2 = 0)
    SELECT 'scored' AS part, frame_index FROM (SELECT * FROM s UNION SELECT * FROM l) UNION ALL SELECT 'empty', frame_index FROM (SELECT * FROM s EXCEPT SELECT * FROM l)
    UNION ALL SELECT 'labelled', frame_index FROM l""",
    "frame_denominator": CTES + "SELECT count(*) AS frames FROM (SELECT frame_index FROM detections WHERE label = 7 UNION SELECT frame_index FROM phases WHERE frame_index % 3 = 0)",
    "parsed_indices": """SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_concat([n_nationkey, 5], generate_series(3, n_nationkey + 4)))), ',') AS numbers FROM nation""",
    "map_frame_plan": CTES
    + _PER
    + """, r AS (SELECT p.frame_index, floor(CASE WHEN p.frame_index % 6 > 0 THEN predicted_phase_px ELSE p.frame_index % 14723e0 END / 14723e0 * 64) AS b,
        CASE WHEN p.frame_index % 5 > 0 THEN n ELSE 0 END + 10 * greatest(0e0, 1 - CASE WHEN p.frame_index % 6 > 0 THEN score ELSE 1 END) AS c, CASE WHEN p.frame_index % 5 > 0 THEN n ELSE 0 END AS k
        FROM phases p JOIN per_frame USING (frame_index)), t AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY c, frame_index) AS t FROM r)
    SELECT frame_index, CAST(b AS BIGINT) AS bucket, round(c, 6) AS cost, k AS n_detections, CAST(t AS INT) AS turn FROM t ORDER BY t, b LIMIT 100""",
    "velocity_subset": CTES
    + """, e AS (SELECT track_id, min(frame_index) AS frame_start, CASE WHEN track_id % 3 > 0 THEN max(frame_index) END AS frame_end FROM tracks GROUP BY 1)
    SELECT * FROM e WHERE CAST(CASE WHEN frame_end IS NULL THEN frame_start ELSE round_even((frame_start + frame_end) / 2, 0) END AS BIGINT) IN
      (SELECT frame_index FROM phases WHERE frame_index % 2 = 0 AND frame_index < 600)""",
    "audited_boxes": CTES
    + """SELECT frame_index, label, bbox_top <= 5 AS at_top, bbox_left <= 5 AS at_left, bbox_bottom >= 475 AS at_bottom, bbox_right >= 615 AS at_right,
      h >= 3 AND w >= 3 AND greatest(h / w, w / h) <= 3 AS passes_shape, bbox_top <= 5 OR bbox_left <= 5 OR bbox_bottom >= 475 OR bbox_right >= 615 AS is_truncated
    FROM (SELECT *, bbox_bottom - bbox_top AS h, bbox_right - bbox_left AS w FROM detections) WHERE h > 0 AND w > 0""",
}

_MERGED = """WITH a AS (SELECT 'v' || p_partkey AS variant, p_size / 50e0 AS f1, p_partkey % 7 AS fp, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 9 END AS n FROM part WHERE p_partkey <= 120),
  b AS (SELECT 'v' || (p_partkey + 20) AS variant, p_partkey % 5 AS fd, p_partkey % 11 AS m FROM part WHERE p_partkey <= 120 AND p_partkey % 4 > 0),
  j AS (SELECT variant, f1, fp, fd, coalesce(n, m) AS n, b.variant IS NOT NULL AS other FROM a FULL JOIN b USING (variant)),
  e AS (SELECT variant, f1 AS labeled_f1, n AS n_tracks, CASE WHEN coalesce(n, 0) > 0 AND other THEN 1 / n ELSE 0e0 END AS share, CASE WHEN other THEN 0.5e0 ELSE 0e0 END AS mask,
    concat_ws(';', CASE WHEN f1 IS NULL THEN 'labeled_f1' END, CASE WHEN fp IS NULL THEN 'fp_per_frame' END, CASE WHEN fd IS NULL THEN 'map_only_false_detections' END,
      CASE WHEN NOT other THEN 'map_only_false_long_tracks' END, CASE WHEN NOT other THEN 'map_only_false_accepted_tracks' END) AS missing, fp, fd FROM j),
  s AS (SELECT variant, round(labeled_f1, 6) AS labeled_f1, n_tracks, round(share, 6) AS small_accepted_tracks_share, mask AS mask_burden, missing AS missing_score_terms,
    CASE WHEN missing = '' THEN round(labeled_f1 - 0.01e0 * fp - 0.05e0 * fd - 0.1e0 * share - 0.1e0 * mask, 6) END AS ghost_objective_score, missing = '' AS eligible_for_selection FROM e)
"""
ORACLE_SQL["merged_evidence"] = _MERGED + "SELECT * FROM s"
ORACLE_SQL["evidence_winner"] = _MERGED + "SELECT variant, ghost_objective_score FROM s WHERE eligible_for_selection ORDER BY ghost_objective_score DESC, variant LIMIT 1"
