"""Registered queries of the library and their DuckDB text."""

from pyspark.sql import functions as F

from loopsight.functions import boxes
from loopsight.operators import assignment, checks, fragments, matching, sampling, surface, velocity
from loopsight.plans import measures, projections, surface_maps
from loopsight.sources import views as v
from loopsight.sources.views import CTES
from loopsight.streaming import frames

FLAGSHIP = "iou_mutual_best_f1"
PERIOD, BELT = int(v.PERIOD), v.VELOCITY


def _rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _per_frame(spark, d):
    return checks.detections_per_frame(v.phases(spark, d), v.detections(spark, d))


def _pairs(spark, d):
    return matching.iou_pairs(v.detections(spark, d), v.truth(spark, d))


def _p_values(spark, d):
    """Of detections, a quarter of which stand out by 8, against those that truth doesn't hold."""
    more = F.when(F.col("label") % 4 == 1, 8.0).otherwise(0.0)
    scored = v.detections(spark, d).withColumn("score", F.col("peak_signal") + more)
    return sampling.empirical_p_values(scored.where("label % 4 <> 0"), scored.where("label % 4 = 0"))


QUERIES = {
    "iou_pairs": lambda s, d: _rounded(_pairs(s, d).select("frame_index", "label", "truth_id", "iou")),
    "iou_mutual_best": lambda s, d: _rounded(matching.mutual_best(_pairs(s, d)).select("frame_index", "label", "truth_id", "iou")),
    "iou_mutual_best_f1": lambda s, d: _rounded(matching.precision_recall(v.detections(s, d), v.truth(s, d))),
    "froc_envelope": lambda s, d: _rounded(
        matching.froc_curve(v.detections(s, d), v.truth(s, d), v.phases(s, d).count())
    ),
    "froc_rematched": lambda s, d: _rounded(
        matching.froc_rematched(v.detections(s, d), v.truth(s, d), v.phases(s, d).count())
    ),
    "box_audit": lambda s, d: matching.audit_boxes(v.detections(s, d), v.HEIGHT, v.WIDTH),
    "box_areas": lambda s, d: velocity.describe(
        v.detections(s, d).select(F.floor(boxes.area(boxes.sides("bbox_")) * 3 / 4).alias("area")), "area"
    ),
    "confidence_trust": lambda s, d: _rounded(matching.confidence(
        v.detections(s, d).withColumn("area_px", F.floor(boxes.area(boxes.sides("bbox_")) * 3 / 4)), 5.0, v.HEIGHT, v.WIDTH
    )),
    "detections_per_frame": _per_frame,
    "missing_numbers": lambda s, d: checks.missing_numbers(v.phases(s, d)),
    "duplicate_hashes": lambda s, d: checks.duplicate_contents(v.table(s, d, "documents"), "doc_id", "text"),
    "worst_frames": lambda s, d: checks.worst_frames(_per_frame(s, d), v.phases(s, d)),
    "drift_slopes": lambda s, d: _rounded(checks.drift(_per_frame(s, d), v.phases(s, d)), 9),
    "phase_errors": lambda s, d: surface.phase_errors(v.phases(s, d), v.PERIOD),
    "phase_error_stats": lambda s, d: _rounded(surface.error_summary(surface.phase_errors(v.phases(s, d), v.PERIOD))),
    "row_exposure": lambda s, d: surface.row_exposure(v.phases(s, d), PERIOD),
    "map_uncertainty": lambda s, d: _rounded(surface.uncertainty(surface.row_exposure(v.phases(s, d), PERIOD))),
    "map_splat_linear": lambda s, d: _rounded(
        surface.splat_linear(v.belt_map(s, d), F.col("belt_row") * 0.25, v.table(s, d, "embeddings").count())
    ),
    "static_noise": lambda s, d: _rounded(surface.static_noise(v.belt_map(s, d))),
    "artifact_counts": lambda s, d: surface.artifact_counts(v.detections(s, d), v.phases(s, d), PERIOD),
    "split_grouping_sets": lambda s, d: _rounded(surface.split_summary(v.phases(s, d))),
    "track_extents": lambda s, d: _rounded(velocity.track_extents(v.tracks(s, d))),
    "velocity_ols": lambda s, d: _rounded(velocity.least_squares(v.tracks(s, d), BELT)),
    "velocity_theil_sen": lambda s, d: _rounded(velocity.theil_sen(v.tracks(s, d))),
    "velocity_repeated_median": lambda s, d: _rounded(velocity.repeated_median(v.tracks(s, d))),
    "match_optimal": lambda s, d: _rounded(assignment.optimal_matches(v.detections(s, d), v.truth(s, d))),
    "track_fragments": lambda s, d: fragments.track_fragments(v.tracks(s, d)),
    "map_blend": lambda s, d: _rounded(
        frames.blended(v.belt_map(s, d), v.belt_map(s, d).where("x % 3 > 0").withColumn("v", F.col("v") * 2), 0.25)
    ),
    "sample_indices": lambda s, d: sampling.sample_indices(s, v.phases(s, d).count(), 500),
    "round_robin_plan": lambda s, d: _rounded(sampling.round_robin_plan(v.phases(s, d), v.PERIOD, 24, 300)),
    "frames_by_density": lambda s, d: _rounded(sampling.frames_by_density(v.detections(s, d), 8.0)),
    "empirical_p_values": lambda s, d: _rounded(_p_values(s, d), 9),
    "fdr_threshold": lambda s, d: _rounded(sampling.fdr_threshold(_p_values(s, d), 0.5)),
    "velocity_gates": lambda s, d: velocity.gates(velocity.least_squares(v.tracks(s, d), BELT)),
}

_P_VALUES = """, c AS (
  SELECT peak_signal + CASE WHEN label % 4 = 1 THEN 8e0 ELSE 0e0 END AS score, count(*) FILTER (label % 4 <> 0) AS n, count(*) FILTER (label % 4 = 0) AS b
  FROM detections GROUP BY 1
), pv AS (
  SELECT score, n, (above + 1) / (total + 1) AS p FROM (
    SELECT *, sum(b) OVER (ORDER BY score DESC) AS above, sum(b) OVER () AS total FROM c) WHERE n > 0)
"""
_OLS = """, ols AS (
  SELECT track_id, count(*) AS n_detections, regr_slope(y, frame_index) AS v_y, regr_slope(x, frame_index) AS v_x
  FROM tracks GROUP BY track_id)
"""
_SLOPES = """, slopes AS (
  SELECT a.track_id, a.frame_index AS t, b.frame_index AS t2, a.y, (b.y - a.y) / (b.frame_index - a.frame_index) AS slope
  FROM tracks a JOIN tracks b USING (track_id) WHERE a.frame_index <> b.frame_index)
"""
_PER_FRAME = """, per_frame AS (
  SELECT p.frame_index, count(d.label) AS n_detections
  FROM phases p LEFT JOIN detections d USING (frame_index) GROUP BY p.frame_index)
"""
_EXPOSURE = """, exposure AS (
  SELECT CAST(r % 14723 AS BIGINT) AS belt_row, sum(w) AS exposure FROM (
    SELECT floor(predicted_phase_px) AS r, 1 - (predicted_phase_px - floor(predicted_phase_px)) AS w FROM phases
    UNION ALL SELECT floor(predicted_phase_px) + 1, predicted_phase_px - floor(predicted_phase_px) FROM phases)
  WHERE w > 0 GROUP BY 1)
"""
_ERRORS = """, errors AS (
  SELECT frame_index, t AS true_phase_px, ((predicted_phase_px - t + 7361.5) % 14723 + 14723) % 14723 - 7361.5 AS error_px
  FROM (SELECT *, ((predicted_phase_px + correction_px) % 14723 + 14723) % 14723 AS t FROM phases))
"""

ORACLE_SQL = {
    "iou_pairs": CTES + "SELECT frame_index, label, truth_id, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.25e0",
    "iou_mutual_best": CTES + "SELECT frame_index, label, truth_id, round(iou, 6) AS iou FROM best",
    "iou_mutual_best_f1": CTES
    + """SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM (
      SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM (
        SELECT tp, nd - tp AS fp, nt - tp AS fn FROM (SELECT (SELECT count(*) FROM best) AS tp,
          (SELECT count(*) FROM detections) AS nd, (SELECT count(*) FROM truth) AS nt)))""",
    "froc_envelope": CTES
    + """, c AS (
      SELECT floor(peak_signal) AS cell, count(b.label) AS hits, count(*) AS n
      FROM detections d LEFT JOIN (SELECT frame_index, label FROM best) b USING (frame_index, label) GROUP BY 1
    ), k AS (
      SELECT cell, CAST(sum(hits) OVER w AS BIGINT) AS tp, CAST(sum(n - hits) OVER w AS BIGINT) AS fp FROM c
      WINDOW w AS (ORDER BY cell DESC)
    ), m AS (
      SELECT *, tp / (SELECT count(*) FROM truth) AS recall, fp / (SELECT count(*) FROM phases) AS f FROM k
    )
    SELECT cell AS threshold, tp, fp, round(recall, 6) AS recall, round(f, 6) AS fp_per_frame,
      round(max(recall) OVER (ORDER BY f, recall), 6) AS envelope FROM m""",
    "box_audit": CTES
    + """SELECT frame_index, label, bbox_top <= 0 AS at_top, bbox_left <= 0 AS at_left, bbox_bottom >= 480 AS at_bottom,
      bbox_right >= 620 AS at_right, h >= 4 AND w >= 4 AND greatest(h / w, w / h) <= 4 AS passes_shape,
      bbox_top <= 0 OR bbox_left <= 0 OR bbox_bottom >= 480 OR bbox_right >= 620 AS is_truncated
    FROM (SELECT *, bbox_bottom - bbox_top AS h, bbox_right - bbox_left AS w FROM detections) WHERE h > 0 AND w > 0""",
    "box_areas": CTES
    + """SELECT count(a) AS count, avg(a) AS mean, median(a) AS median, CAST(min(a) AS BIGINT) AS min,
      CAST(max(a) AS BIGINT) AS max, quantile_cont(a, 0.25) AS q25, quantile_cont(a, 0.75) AS q75
    FROM (SELECT floor((bbox_bottom - bbox_top) * (bbox_right - bbox_left) * 3 / 4) AS a FROM detections)""",
    "confidence_trust": CTES
    + """SELECT frame_index, label, round(1 / (1 + exp(-(peak_signal - 5) / 5)) * (0.5 + 0.5 * least(1, a / 20)) * (1 - overlap)
      * CASE WHEN bbox_top <= 0 OR bbox_left <= 0 OR bbox_bottom >= 480 OR bbox_right >= 620 THEN 0.75 ELSE 1 END, 6) AS confidence
    FROM (SELECT *, floor((bbox_bottom - bbox_top) * (bbox_right - bbox_left) * 3 / 4) AS a FROM detections)""",
    "detections_per_frame": CTES + _PER_FRAME + "SELECT * FROM per_frame",
    "missing_numbers": CTES
    + """SELECT frame_index FROM (SELECT unnest(generate_series(min(frame_index), max(frame_index))) AS frame_index FROM phases)
      WHERE frame_index NOT IN (SELECT frame_index FROM phases)""",
    "duplicate_hashes": 'SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS "first" FROM documents GROUP BY 1 HAVING n > 1',
    "worst_frames": CTES
    + _PER_FRAME
    + """(SELECT 'detections' AS metric, frame_index, CAST(n_detections AS DOUBLE) AS value FROM per_frame
        ORDER BY value DESC, frame_index LIMIT 10)
      UNION ALL (SELECT 'correction', frame_index, abs(correction_px) AS value FROM phases ORDER BY value DESC, frame_index LIMIT 10)""",
    "drift_slopes": CTES
    + _PER_FRAME
    + """SELECT round(regr_slope(n_detections, frame_index), 9) AS detections_slope,
      round(regr_slope(correction_px, frame_index), 9) AS correction_slope, round(regr_slope(score, frame_index), 9) AS score_slope
    FROM per_frame JOIN phases USING (frame_index)""",
    "phase_errors": CTES + _ERRORS + "SELECT * FROM errors",
    "phase_error_stats": CTES
    + _ERRORS
    + """SELECT count(error_px) AS n, round(avg(error_px), 6) AS bias, round(avg(abs(error_px)), 6) AS mae,
      round(median(abs(error_px)), 6) AS median_abs, round(quantile_cont(abs(error_px), 0.95), 6) AS p95_abs,
      round(max(abs(error_px)), 6) AS max_abs, round(sqrt(avg(error_px * error_px)), 6) AS rmse FROM errors""",
    "row_exposure": CTES + _EXPOSURE + "SELECT * FROM exposure",
    "map_uncertainty": CTES
    + _EXPOSURE
    + "SELECT belt_row, round(1 / sqrt(greatest(exposure, 1)), 6) AS uncertainty FROM exposure",
    "map_splat_linear": CTES
    + """SELECT CAST(r % (SELECT count(*) FROM embeddings) AS BIGINT) AS belt_row, x, round(sum(w * v) / sum(w), 6) AS v,
      round(sum(w), 6) AS support FROM (
        SELECT floor(belt_row * 1.25e0) AS r, 1 - (belt_row * 1.25e0 - floor(belt_row * 1.25e0)) AS w, x, v FROM belt_map
        UNION ALL SELECT floor(belt_row * 1.25e0) + 1, belt_row * 1.25e0 - floor(belt_row * 1.25e0), x, v FROM belt_map)
    WHERE w > 0 GROUP BY 1, 2""",
    "static_noise": CTES
    + """, m AS (SELECT x, median(v) AS b FROM belt_map GROUP BY x)
    SELECT x, round(b, 6) AS background, round(greatest(median(abs(v - b)) * 1.4826e0, 1e-6), 6) AS noise
    FROM belt_map JOIN m USING (x) GROUP BY x, b""",
    "artifact_counts": CTES
    + """SELECT CAST(floor(r / 20) AS BIGINT) AS row_cell, CAST(floor(bbox_left / 20) AS BIGINT) AS x_cell,
      count(DISTINCT revolution) AS revolutions, count(*) AS hits FROM (
        SELECT *, floor((bbox_top + bbox_bottom - 1) * 0.5e0 + predicted_phase_px + 0.5e0) % 14723 AS r
        FROM detections JOIN phases USING (frame_index))
    GROUP BY 1, 2 HAVING revolutions >= 2""",
    "split_grouping_sets": CTES
    + """SELECT split, revolution, count(*) AS frames, round(avg(score), 6) AS mean_score
    FROM (SELECT *, CASE WHEN revolution % 2 = 0 THEN 'train' ELSE 'eval' END AS split FROM phases)
    GROUP BY GROUPING SETS ((split), (split, revolution))""",
    "track_extents": CTES
    + """SELECT track_id, count(*) AS n_detections, min(frame_index) AS frame_start, max(frame_index) AS frame_end,
      round(median(y), 6) AS median_y, round(median(x), 6) AS median_x FROM tracks GROUP BY track_id""",
    "velocity_ols": CTES
    + _OLS
    + """SELECT track_id, n_detections, round(v_y, 6) AS v_y, round(v_x, 6) AS v_x, round(sqrt(v_y * v_y + v_x * v_x), 6) AS speed,
      round(v_y / 59.25e0, 6) AS ratio FROM ols""",
    "velocity_theil_sen": CTES
    + _SLOPES
    + "SELECT track_id, round(median(slope), 6) AS v_y, count(*) AS n_pairs FROM slopes WHERE t < t2 GROUP BY track_id",
    "velocity_repeated_median": CTES
    + _SLOPES
    + """SELECT track_id, round(median(m), 6) AS v_y FROM (
      SELECT track_id, median(slope) AS m FROM slopes GROUP BY track_id, t, y) GROUP BY track_id""",
    "velocity_gates": CTES
    + _OLS
    + """SELECT track_id, n_detections >= 5 AS passes_length, v_y / 59.25e0 >= 0 AS passes_low, v_y / 59.25e0 <= 1.1e0 AS passes_high,
      n_detections >= 5 AND v_y / 59.25e0 >= 0 AND v_y / 59.25e0 <= 1.1e0 AS accepted FROM ols""",
    "track_fragments": CTES
    + """, f AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM tracks
      WINDOW w AS (PARTITION BY track_id ORDER BY frame_index)),
    g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY track_id ORDER BY frame_index) AS BIGINT) AS fragment FROM f)
    SELECT track_id, fragment, min(frame_index) AS frame_start, max(frame_index) AS frame_end, count(*) AS n FROM g GROUP BY 1, 2""",
    "map_blend": CTES
    + "SELECT belt_row, x, round(CASE WHEN x % 3 > 0 THEN v * 0.75e0 + v * 2 * 0.25e0 ELSE v END, 6) AS v FROM belt_map",
    "sample_indices": "SELECT DISTINCT CASE WHEN i = 499 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 499.0e0)) AS BIGINT) END AS frame_index FROM range(500) t(i), (SELECT count(*) AS n FROM orders)",
    "round_robin_plan": CTES
    + """, r AS (
      SELECT frame_index, CAST(least(floor(predicted_phase_px / (14723e0 / 24)), 23) AS BIGINT) AS bucket, 1 - score AS cost FROM phases
    ), t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY cost, frame_index) AS turn FROM r)
    SELECT frame_index, bucket, round(cost, 6) AS cost, turn FROM t ORDER BY turn, bucket LIMIT 300""",
    "frames_by_density": CTES
    + """SELECT frame_index, round(avg(CASE WHEN peak_signal > 8 THEN 1.0e0 ELSE 0.0e0 END), 6) AS density, count(*) AS n
    FROM detections GROUP BY frame_index""",
    "empirical_p_values": CTES + _P_VALUES + "SELECT score, n, round(p, 9) AS p FROM (SELECT round(score, 9) AS score, n, p FROM pv)",
    "fdr_threshold": CTES
    + _P_VALUES
    + """, k AS (SELECT p, sum(n) AS n, min(score) AS score FROM pv GROUP BY p),
    r AS (SELECT *, sum(n) OVER (ORDER BY p) AS rank, (SELECT sum(n) FROM pv) AS m FROM k)
    SELECT round(max(p), 6) AS cutoff, round(min(score), 6) AS threshold, CAST(sum(n) AS BIGINT) AS discoveries
    FROM r WHERE p <= 0.5e0 * rank / m""",
}

for _theme in (projections, surface_maps, measures):
    QUERIES |= _theme.QUERIES
    ORACLE_SQL |= _theme.ORACLE_SQL
