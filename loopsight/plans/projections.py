"""Row-wise arithmetic: phases, boxes, scores, labels."""

from pyspark.sql import functions as F

from loopsight.functions import boxes, cyclic, scores, values
from loopsight.operators import matching
from loopsight.plans.common import columns, rounded
from loopsight.sources import views as v
from loopsight.sources.views import CTES


def phase_projections(s, d):
    p, frame = v.phases(s, d), F.col("frame_index")
    phase, row = F.col("predicted_phase_px"), F.pmod(frame * 7.5, F.lit(v.PERIOD))
    listed = F.array(*[F.lit(x) for x in (0.0, 10.5, 20.25, None, 14800.0)])
    return rounded(p.select(
        "frame_index", cyclic.phase_at(frame, v.VELOCITY, v.PERIOD, 11.5, 3.0).alias("model_phase"),
        cyclic.phase_at(frame, v.VELOCITY, None).alias("strip_phase"),
        cyclic.circular_distance(phase, row, v.PERIOD).alias("distance"),
        cyclic.surface_row(row, phase, v.PERIOD).alias("surface_row"),
        cyclic.visible(row, phase, v.HEIGHT, v.PERIOD).alias("visible"),
        cyclic.revolution_of(frame, F.lit(2), v.VELOCITY, v.PERIOD).cast("long").alias("revolution"),
        cyclic.phase_fraction(phase, v.PERIOD).alias("fraction"), cyclic.phase_radians(phase, v.PERIOD).alias("radians"),
        cyclic.true_phase(frame, listed, F.lit(2.5), F.lit(v.PERIOD)).alias("true_phase"),
        cyclic.supplied_velocity(F.col("score"), F.when(frame % 3 == 0, "source_frame").when(frame % 3 == 1, "selected_frame"), frame % 2 + 1).alias("velocity"),
    ))


def phase_unwrapped(s, d):
    p = v.phases(s, d).withColumn("run", F.floor(F.col("frame_index") / 500))
    return rounded(cyclic.unwrap(p, "predicted_phase_px", "frame_index", ["run"], v.PERIOD).select("frame_index", "unwrapped"), 4)


def phase_circular_means(s, d):
    """Added up in the order of frames: the last bits of a sum say on which side of the seam a mean is, and files may be split anywhere."""
    ordered = v.phases(s, d).repartition("revolution").sortWithinPartitions("revolution", "frame_index")
    return rounded(ordered.groupBy("revolution").agg(cyclic.circular_mean(F.col("predicted_phase_px"), v.PERIOD).alias("mean_phase")), 4)


def box_projections(s, d):
    a, b = boxes.sides("bbox_"), boxes.sides("t_")
    y = F.when(F.col("label") % 2 == 0, F.col("bbox_top") + 1.25)
    one, other = boxes.centre(a, y, F.col("bbox_left") + 0.5), boxes.middle(b)
    pairs = matching.iou_pairs(v.detections(s, d), v.truth(s, d))
    return rounded(pairs.select(
        "frame_index", "label", "truth_id", one[0].alias("centre_y"), one[1].alias("centre_x"), boxes.distance(one, other).alias("distance"),
        boxes.diagonal(b).alias("diagonal"), boxes.containment(a, b).alias("containment"),
    ))


def detector_boxes(s, d):
    share = lambda c, n: F.pmod(F.col(c), F.lit(n)) / float(n - 1)
    found = boxes.pixel_box(
        share("l_partkey", 101), share("l_suppkey", 53), F.col("l_discount"), F.col("l_tax") * 2, F.lit(640), F.lit(480)
    )
    rows = v.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *columns(found))
    return rounded(rows.where("bbox_top is not null"))


def _measured(s, d):
    """Detections with the measures that scores need; some are missing."""
    det = v.detections(s, d)
    h, w = F.col("bbox_bottom") - F.col("bbox_top"), F.col("bbox_right") - F.col("bbox_left")
    return det.select(
        "frame_index", "label", F.when(F.col("label") % 5 != 0, F.col("peak_signal")).alias("peak"), (F.col("peak_signal") / 2).alias("mean"),
        F.when(F.col("label") % 7 != 0, F.floor(h * w * 3 / 4)).alias("area"), F.when(F.col("label") % 3 != 0, F.col("overlap") * 1.5).alias("overlap"),
        (F.col("overlap") / 2).alias("probability"), h.alias("height"), w.alias("width"), (F.col("bbox_top") < 20).alias("truncated"),
    )


def detection_confidence(s, d):
    det, phases = _measured(s, d), v.phases(s, d).select("frame_index", "score")
    row = {c: F.col(c) for c in ("peak", "mean", "area", "overlap", "probability", "height", "width")}
    joined = det.join(phases.where("frame_index % 4 > 0"), "frame_index", "left")
    return rounded(joined.select("frame_index", "label", *columns(scores.detection_scores(row, F.col("score")))))


def confidence_trusted(s, d):
    args = [F.col(c) for c in ("peak", "mean", "area", "overlap", "truncated")]
    return rounded(_measured(s, d).select("frame_index", "label", scores.trust_confidence(*args, 6.0).alias("confidence")))


def event_classes(s, d):
    det = v.detections(s, d)
    some = lambda c, n: F.when(F.col("label") % n != 0, c)
    found = scores.event_class(
        some(F.col("overlap"), 3), some(F.col("bbox_top") / 300, 4), some(F.col("peak_signal"), 5), some(F.col("bbox_left") / 50, 2)
    )
    found["reasons"] = F.array_join(found["reasons"], "; ")
    found["class"] = found.pop("label")
    return rounded(det.select("frame_index", "label", *columns(found), scores.peak_ratio(F.col("overlap"), F.col("peak_signal")).alias("ratio")))


def error_taxonomy(s, d):
    det = v.detections(s, d)
    args = (
        F.when(F.col("label") % 2 == 0, "TP").otherwise("FP"), F.col("bbox_top") % 4, F.col("overlap") > 0.7, F.col("bbox_left") % 3,
        F.col("overlap"), F.when(F.col("label") % 3 != 0, F.lit(0.4)),
    )
    return rounded(det.select(
        "frame_index", "label", scores.taxonomy(*args).alias("taxonomy"),
        scores.recurrence_ratio(F.col("overlap") - 0.5, F.col("peak_signal") - 8, 1.0).alias("ratio"),
        scores.reranked(F.col("overlap"), F.when(F.col("label") == 1, F.lit(0.25)), 1 - F.col("overlap") / 2).alias("adjusted"),
        scores.inflation(1.5, 0.2, F.when(F.col("label") != 2, F.col("peak_signal"))).alias("inflation"),
    ))


def registration_gates(s, d):
    row = {
        "method": F.when(F.col("frame_index") % 5 == 0, "motion_model").otherwise("registration"), "score": F.col("score"),
        "loss_gap_ratio": F.when(F.col("frame_index") % 7 != 0, F.col("score") * 2), "uncertainty_px": F.abs("correction_px") / 4,
        "correction_px": F.col("correction_px"),
    }
    reasons = scores.registration_reasons(row, {"score": 0.2, "loss_gap_ratio": 0.3, "uncertainty_px": 1.5, "correction_px": 7.0})
    rows = v.phases(s, d).select("frame_index", F.array_join(reasons, "+").alias("reasons"))
    return rows.withColumn("action", F.when(F.col("reasons") == "", "accept").otherwise("inflate"))


def track_confidences(s, d):
    t = v.tracks(s, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("peak"), F.stddev_pop("x").alias("rmse"), F.regr_slope("y", "frame_index").alias("ratio"))
    some = F.when(F.col("track_id") % 3 != 0, F.col("ratio") * 100)
    return rounded(t.select("track_id", scores.track_confidence(F.col("n"), 60, F.col("peak") / 20, F.col("rmse") / 10, some).alias("confidence")))


def variant_scores(s, d):
    p = v.table(s, d, "part").where("p_partkey <= 150").selectExpr(
        "case when p_partkey = 3 then 'raw_robust_zscore' else concat('v', p_partkey) end as variant",
        "case when p_partkey % 11 > 0 then p_size / 50e0 end as labeled_f1", "p_partkey % 7 as fp_per_frame", "p_partkey % 5 as map_only_false_detections",
        "p_partkey % 3 as map_only_false_long_tracks", "p_partkey % 2 as map_only_false_accepted_tracks", "p_partkey % 13 as n_tracks",
        "p_partkey % 4 as small_accepted_tracks", "case when p_partkey % 6 > 0 then 0.25e0 end as masked_pixel_fraction",
        "0.125e0 as recurrent_artifact_fraction_from_map",
    )
    return rounded(p.select("variant", *columns(scores.variant_score())))


def parsed_cells(s, d):
    cells = v.table(s, d, "events").select("event_id", F.expr(
        "case event_id % 8 when 0 then ' 7.0 ' when 1 then '7.5' when 2 then 'nan' when 3 then '' when 4 then 'x' when 5 then 'inf' when 6 then cast(event_id as string) end"
    ).alias("cell"))
    return cells.select("event_id", values.number(F.col("cell")).alias("number"), values.whole(F.col("cell")).alias("whole"))


QUERIES = {
    f.__name__: f
    for f in (
        phase_projections, phase_unwrapped, phase_circular_means, box_projections, detector_boxes, detection_confidence,
        confidence_trusted, event_classes, error_taxonomy, registration_gates, track_confidences, variant_scores, parsed_cells,
    )
}

_MEASURED = """, measured AS (
  SELECT frame_index, label, CASE WHEN label % 5 <> 0 THEN peak_signal END AS peak, peak_signal / 2 AS mean,
    CASE WHEN label % 7 <> 0 THEN floor((bbox_bottom-bbox_top)*(bbox_right-bbox_left)*3/4) END AS area,
    CASE WHEN label % 3 <> 0 THEN overlap * 1.5e0 END AS overlap, overlap / 2 AS probability,
    bbox_bottom - bbox_top AS height, bbox_right - bbox_left AS width, bbox_top < 20 AS truncated FROM detections)
"""


def _wrap(x: str) -> str:
    return f"((({x}) % 14723e0 + 14723e0) % 14723e0)"


_ROW = "(frame_index * 7.5e0 % 14723e0)"
ORACLE_SQL = {
    "phase_projections": CTES
    + f"""SELECT frame_index, round({_wrap('11.5e0 - 59.25e0 * (frame_index - 3)')}, 6) AS model_phase, -59.25e0 * frame_index AS strip_phase,
      round(least(abs(predicted_phase_px - {_ROW}), 14723e0 - abs(predicted_phase_px - {_ROW})), 6) AS distance,
      round({_wrap(f'{_ROW} + predicted_phase_px')}, 6) AS surface_row, {_wrap(f'{_ROW} - predicted_phase_px')} < 480 AS visible,
      CAST(floor(59.25e0 * (frame_index - 2) / 14723e0) AS BIGINT) AS revolution, round(predicted_phase_px / 14723e0, 6) AS fraction,
      round(predicted_phase_px / 14723e0 * 2 * pi(), 6) AS radians,
      round({_wrap('coalesce(CASE frame_index WHEN 0 THEN 0e0 WHEN 1 THEN 10.5e0 WHEN 2 THEN 20.25e0 WHEN 4 THEN 14800e0 END, -2.5e0 * frame_index)')}, 6) AS true_phase,
      round(CASE frame_index % 3 WHEN 0 THEN score * (frame_index % 2 + 1) WHEN 1 THEN score ELSE CASE WHEN frame_index % 2 = 0 THEN score END END, 6) AS velocity
    FROM phases""",
    "phase_unwrapped": CTES
    + """, st AS (SELECT *, predicted_phase_px - lag(predicted_phase_px) OVER w AS d FROM (SELECT *, floor(frame_index / 500) AS run FROM phases)
        WINDOW w AS (PARTITION BY run ORDER BY frame_index)),
      n AS (SELECT *, ((d + 7361.5e0) % 14723e0 + 14723e0) % 14723e0 - 7361.5e0 AS m FROM st)
    SELECT frame_index, round(predicted_phase_px + sum(coalesce(CASE WHEN m = -7361.5e0 AND d > 0 THEN 7361.5e0 ELSE m END - d, 0))
      OVER (PARTITION BY run ORDER BY frame_index), 4) AS unwrapped FROM n""",
    "phase_circular_means": CTES
    + """SELECT revolution, CASE WHEN sqrt(a * a + b * b) > 1e-12 THEN round(((atan2(b, a) + 2 * pi()) % (2 * pi())) * 14723e0 / (2 * pi()), 4) END AS mean_phase
    FROM (SELECT revolution, avg(cos(predicted_phase_px * 2 * pi() / 14723e0)) AS a, avg(sin(predicted_phase_px * 2 * pi() / 14723e0)) AS b
      FROM phases GROUP BY revolution)""",
    "box_projections": CTES
    + """SELECT frame_index, label, truth_id, cy AS centre_y, cx AS centre_x,
      round(sqrt((cy - (t_top + t_bottom - 1) * 0.5e0) ** 2 + (cx - (t_left + t_right - 1) * 0.5e0) ** 2), 6) AS distance,
      round(sqrt((t_bottom - t_top) ** 2 + (t_right - t_left) ** 2), 6) AS diagonal,
      round(i / least((bbox_bottom-bbox_top)*(bbox_right-bbox_left), (t_bottom-t_top)*(t_right-t_left)), 6) AS containment
    FROM (SELECT *, CASE WHEN label % 2 = 0 THEN bbox_top + 1.25e0 ELSE (bbox_top + bbox_bottom - 1) * 0.5e0 END AS cy,
      CASE WHEN label % 2 = 0 THEN bbox_left + 0.5e0 ELSE (bbox_left + bbox_right - 1) * 0.5e0 END AS cx FROM pairs WHERE iou >= 0.25e0)""",
    "detector_boxes": """
      WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey % 101 / 100e0 AS x, l_suppkey % 53 / 52e0 AS y, l_discount AS w, l_tax * 2 AS h FROM lineitem),
      c AS (SELECT *, least(greatest((x - w / 2) * 640, 0e0), 640e0) AS l, least(greatest((x + w / 2) * 640, 0e0), 640e0) AS r,
        least(greatest((y - h / 2) * 480, 0e0), 480e0) AS t, least(greatest((y + h / 2) * 480, 0e0), 480e0) AS b FROM e)
      SELECT l_orderkey, l_linenumber, CAST(floor(t) AS BIGINT) AS bbox_top, CAST(floor(l) AS BIGINT) AS bbox_left, CAST(ceil(b) AS BIGINT) AS bbox_bottom,
        CAST(ceil(r) AS BIGINT) AS bbox_right, round((t + b) * 0.5e0, 6) AS y, round((l + r) * 0.5e0, 6) AS x,
        CAST((ceil(b) - floor(t)) * (ceil(r) - floor(l)) AS BIGINT) AS area_px FROM c WHERE r > l AND b > t""",
    "detection_confidence": CTES
    + _MEASURED
    + """, f AS (SELECT m.frame_index, label, CASE WHEN p.score IS NULL THEN 1e0 ELSE least(greatest(p.score, 0e0), 1e0) END AS reg, 1 - exp(-greatest(0, coalesce(peak, 0)) / 5) AS sig,
        1 - exp(-greatest(0, mean) / 5) AS men, CASE WHEN coalesce(area, 0) <= 0 THEN 1e0
          ELSE sqrt(least(1e0, area / greatest(1, height * width))) END AS shp,
        greatest(0e0, 1 - greatest(coalesce(overlap, 0), probability)) AS pen
      FROM measured m LEFT JOIN (SELECT * FROM phases WHERE frame_index % 4 > 0) p USING (frame_index))
    SELECT frame_index, label, round(reg, 6) AS registration_score, round(sig, 6) AS signal_score, round(shp, 6) AS shape_score,
      round(pen, 6) AS artifact_penalty, round(sig * (0.5e0 + 0.5e0 * men) * shp * reg * pen, 6) AS detection_confidence FROM f""",
    "confidence_trusted": CTES
    + _MEASURED
    + """SELECT frame_index, label, round(1 / (1 + exp(-(coalesce(peak, mean) - 6) / 6)) * (0.5e0 + 0.5e0 * CASE WHEN area IS NULL THEN 0.5e0 ELSE least(1, area / 20) END)
      * (1 - least(1, coalesce(overlap, 0))) * CASE WHEN truncated THEN 0.75e0 ELSE 1 END, 6) AS confidence FROM measured""",
    "event_classes": CTES
    + """, e AS (SELECT frame_index, label AS n, CASE WHEN label % 3 <> 0 THEN overlap END AS o, CASE WHEN label % 4 <> 0 THEN bbox_top / 300 END AS r,
        CASE WHEN label % 5 <> 0 THEN peak_signal END AS p, CASE WHEN label % 2 <> 0 THEN bbox_left / 50 END AS u, overlap, peak_signal FROM detections),
      g AS (SELECT *, coalesce(o > 0.5e0, false) AS a, coalesce(r BETWEEN 0 AND 1.1e0, false) AS b, coalesce(p >= 5, false) AS c, coalesce(u > 5, false) AS d FROM e)
    SELECT frame_index, n AS label, CASE WHEN a THEN 'belt-fixed-artifact' WHEN b THEN 'loose-particle' WHEN d THEN 'map-uncertainty-artifact'
        ELSE 'uncertain' END AS class, round(least(1e0, greatest(0e0, 0.5e0 + CASE WHEN a THEN 0.3e0 ELSE 0 END + CASE WHEN b THEN 0.2e0 ELSE 0 END
        - CASE WHEN r IS NOT NULL AND NOT b THEN 0.15e0 ELSE 0 END + CASE WHEN c THEN 0.1e0 ELSE 0 END - CASE WHEN d THEN 0.1e0 ELSE 0 END)), 6) AS confidence,
      concat_ws('; ', CASE WHEN a THEN 'high recurrent belt-coordinate overlap' END, CASE WHEN b THEN 'physically plausible velocity ratio' END,
        CASE WHEN r IS NOT NULL AND NOT b THEN 'velocity ratio outside expected range' END, CASE WHEN c THEN 'strong residual peak' END,
        CASE WHEN d THEN 'high rendered map uncertainty' END) AS reasons,
      round(CASE WHEN greatest(abs(overlap), abs(peak_signal)) > 0 THEN least(abs(overlap), abs(peak_signal)) / greatest(abs(overlap), abs(peak_signal)) END, 6) AS ratio
    FROM g""",
    "error_taxonomy": CTES
    + """, e AS (SELECT *, CASE WHEN label % 2 = 0 THEN 'TP' ELSE 'FP' END AS role, bbox_top % 4 AS v, overlap > 0.7e0 AS h,
        bbox_left % 3 > 0 OR coalesce(overlap >= CASE WHEN label % 3 <> 0 THEN 0.4e0 END, false) AS k FROM detections)
    SELECT frame_index, label, CASE WHEN v = 0 THEN lower(role) || '_no_valid_revisits' WHEN role = 'FP' AND h THEN 'fp_recurrent_removed'
        WHEN role = 'FP' AND NOT k THEN 'fp_low_shape_supported_recurrence_evidence'
        WHEN role = 'TP' AND h THEN 'tp_high_shape_supported_recurrence_accidentally_removed'
        WHEN k THEN lower(role) || '_shape_supported_recurrent_but_not_hard_rejected' ELSE lower(role) || '_inconclusive_low_recurrence' END AS taxonomy,
      round(greatest(0, overlap - 0.5e0) / greatest(peak_signal - 8, 1e0), 6) AS ratio,
      round(CASE WHEN label = 1 THEN 0.25e0 ELSE overlap END * (1 - overlap / 2), 6) AS adjusted,
      round(CASE WHEN label <> 2 THEN greatest(1.5e0, 1 + 0.2e0 * greatest(0, peak_signal)) ELSE 1.5e0 END, 6) AS inflation FROM e""",
    "registration_gates": CTES
    + """, r AS (SELECT frame_index, CASE WHEN frame_index % 5 = 0 THEN '' ELSE concat_ws('+', CASE WHEN score < 0.2e0 THEN 'score' END,
        CASE WHEN frame_index % 7 = 0 OR score * 2 < 0.3e0 THEN 'loss_gap_ratio' END, CASE WHEN abs(correction_px) / 4 > 1.5e0 THEN 'uncertainty_px' END,
        CASE WHEN abs(correction_px) > 7 THEN 'correction_px' END) END AS reasons FROM phases)
    SELECT *, CASE WHEN reasons = '' THEN 'accept' ELSE 'inflate' END AS action FROM r""",
    "track_confidences": CTES
    + """, t AS (SELECT track_id, count(*) AS n, avg(y) AS peak, stddev_pop(x) AS rmse, regr_slope(y, frame_index) * 100 AS r FROM tracks GROUP BY 1)
    SELECT track_id, round(least(1, n / 60e0) * (1 - exp(-greatest(0, peak / 20) / 5)) / (1 + rmse / 10)
      * CASE WHEN track_id % 3 = 0 OR r BETWEEN 0 AND 1.1e0 THEN 1 ELSE greatest(0, 1 - abs(r - 0.55e0)) END, 6) AS confidence FROM t""",
    "variant_scores": """
      WITH e AS (SELECT CASE WHEN p_partkey = 3 THEN 'raw_robust_zscore' ELSE 'v' || p_partkey END AS variant,
          CASE WHEN p_partkey % 11 > 0 THEN p_size / 50e0 END AS f, p_partkey AS k, CASE WHEN p_partkey % 6 > 0 THEN 0.25e0 ELSE 0.125e0 END AS m,
          CASE WHEN p_partkey % 13 > 0 THEN (p_partkey % 4) / (p_partkey % 13) ELSE 0e0 END AS s FROM part WHERE p_partkey <= 150),
      t AS (SELECT *, concat_ws(';', CASE WHEN f IS NULL THEN 'labeled_f1' END, CASE WHEN k = 3 THEN 'not_a_map_config' END) AS missing FROM e)
      SELECT variant, round(s, 6) AS small_accepted_tracks_share, m AS mask_burden, missing AS missing_score_terms,
        CASE WHEN missing = '' THEN round(f - 0.01e0 * (k % 7) - 0.05e0 * (k % 5) - k % 3 - k % 2 - 0.1e0 * s - 0.1e0 * m, 6) END AS ghost_objective_score,
        missing = '' AS eligible_for_selection FROM t""",
    "parsed_cells": """
      SELECT event_id, CASE event_id % 8 WHEN 0 THEN 7e0 WHEN 1 THEN 7.5e0 WHEN 6 THEN event_id END AS number,
        CASE event_id % 8 WHEN 0 THEN 7 WHEN 6 THEN event_id END AS whole FROM events""",
}
