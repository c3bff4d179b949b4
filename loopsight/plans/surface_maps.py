"""Surface maps: splats, robust means, gaps, risk, rendered views, artifacts, recurrence."""

from pyspark.sql import functions as F

from loopsight.operators import maps, recurrence, risk
from loopsight.plans.common import rounded
from loopsight.sources import views as v
from loopsight.sources.views import CTES

H, W = 200, 16


def _pixels(s, d):
    """Small frames cut from the map: 8 rows of 16 columns, a new frame every 4 rows."""
    return v.belt_map(s, d).where("belt_row < 200 and x < 16").selectExpr(
        "belt_row div 8 as frame_index", "belt_row % 8 as y", "x", "case when (belt_row * 7 + x) % 23 > 0 then v * 10 end as v"
    )


def _frames(s, d):
    """Phases of those frames; they go round the map of 40 rows more than once."""
    return v.table(s, d, "orders").where("o_orderkey < 25").selectExpr("o_orderkey as frame_index", "o_orderkey * 3.25e0 as phase")


def _samples(s, d, **how):
    return maps.splat(_pixels(s, d), _frames(s, d), "phase", 40, **how)


def _strip(s, d):
    return maps.mean_map(maps.splat(_pixels(s, d), _frames(s, d), "phase", 120, periodic=False))


def map_nearest(s, d):
    return rounded(maps.mean_map(_samples(s, d, linear=False)))


def map_strip(s, d):
    return rounded(_strip(s, d))


def map_trimmed(s, d):
    return rounded(maps.robust_map(_samples(s, d), 0.2))


def map_winsorized(s, d):
    return rounded(maps.robust_map(_samples(s, d), 0.2, "winsorized_mean"))


def _sparse(s, d):
    return v.belt_map(s, d).where("belt_row < 200 and x < 16 and (belt_row * 5 + x * 3) % 11 < 4 and x <> 3").withColumn("support", F.col("belt_row") % 3 + 1.0)


def map_gap_fill(s, d):
    return rounded(maps.fill_gaps(_sparse(s, d), H, W))


def map_gap_fill_strip(s, d):
    return rounded(maps.fill_gaps(_sparse(s, d), H, W, periodic=False))


def map_huber_weights(s, d):
    return rounded(maps.huber_weights(_pixels(s, d).withColumnRenamed("v", "raw"), 1.5, 0.01).select("frame_index", "y", "x", "weight"))


def map_static(s, d):
    r = _pixels(s, d).withColumnRenamed("v", "raw")
    return rounded(maps.pixel_medians(r).join(maps.pixel_noise(r), ["y", "x"]))


def frame_zscores(s, d):
    return rounded(maps.frame_zscores(_pixels(s, d).where("v is not null"), 0.01))


def average_background(s, d):
    p = _pixels(s, d)
    return rounded(maps.residual_against(p.where("v is not null"), maps.pixel_means(p)))


def row_counts(s, d):
    return maps.row_counts(v.phases(s, d).where("frame_index % 10 = 0"), "predicted_phase_px", int(v.PERIOD), 48)


def row_coverage(s, d):
    return rounded(maps.row_coverage(v.phases(s, d).where("frame_index % 10 = 0"), "predicted_phase_px", int(v.PERIOD), 48))


def _small(s, d):
    return v.belt_map(s, d).where("belt_row < 200 and x < 16")


def seam_profile(s, d):
    return rounded(maps.seam_profile(_small(s, d), H, 8))


def seam_summary(s, d):
    return rounded(maps.seam_summary(maps.seam_profile(_small(s, d), H, 8)))


def seam_at(s, d):
    return rounded(maps.seam_at(_small(s, d), H, 205, 4))


def map_roll(s, d):
    other = _small(s, d).where("(belt_row + x) % 5 > 0").withColumn("belt_row", (F.col("belt_row") + 37) % H)
    return rounded(maps.best_roll(_small(s, d).where("x < 4"), other, H))


def period_candidates(s, d):
    return rounded(maps.estimate_period(maps.row_profile(v.belt_map(s, d).where("belt_row < 300")).where("belt_row % 17 > 0"), 5, 120, 8))


def map_inpaint(s, d):
    return rounded(maps.inpaint(_small(s, d), _small(s, d).where("(belt_row * 3 + x) % 29 < 4"), 2, H))


def ghost_marks(s, d):
    boxes = v.detections(s, d).where("label = 1").join(v.phases(s, d), "frame_index")
    return rounded(maps.defect_map(maps.marked_cells(boxes, "predicted_phase_px", int(v.PERIOD), v.WIDTH, 1, 470)))


def _corrections(s, d):
    return v.phases(s, d).where("frame_index < 600 and frame_index % 4 > 0").selectExpr("frame_index div 200 as run", "frame_index % 200 as frame_index", "correction_px as correction")


def correction_smoothing(s, d):
    return rounded(maps.smoothed_corrections(_corrections(s, d), 200, 5, ["run"]))


def map_risk(s, d):
    return rounded(risk.risk_maps(_supported(s, d), "support", 2.0).select("belt_row", "x", "support", "observed", "interpolated", "low_support", "risk"))


def _supported(s, d):
    return _small(s, d).withColumn("support", F.when((F.col("belt_row") + F.col("x")) % 7 > 0, (F.col("belt_row") * 3 + F.col("x")) % 4 * 0.75))


def render_views(s, d):
    return rounded(risk.render_view(_small(s, d), _frames(s, d), "phase", 12, H))


def render_strip(s, d):
    frames = _frames(s, d).withColumn("phase", F.col("phase") * 3 - 5)
    return rounded(risk.render_view(_small(s, d), frames, "phase", 12, H, periodic=False))


def render_masks(s, d):
    masked = _small(s, d).select("belt_row", "x", ((F.col("belt_row") * 3 + F.col("x")) % 5 == 0).alias("mask"))
    return risk.render_mask(masked, _frames(s, d), "phase", 12, H)


def _boxes(s, d):
    """Small boxes within the frames of _frames, some beyond their edges."""
    return v.detections(s, d).where("frame_index < 25").selectExpr(
        "frame_index", "label", "bbox_top % 14 - 2 as bbox_top", "bbox_left % 15 - 1 as bbox_left", "bbox_top % 14 + label % 3 as bbox_bottom",
        "bbox_left % 15 + 1 + label % 4 as bbox_right", "peak_signal", "cast(6 as bigint) as area_px",
    )


def map_support_risk(s, d):
    cells = risk.risk_maps(_supported(s, d), "support", 2.0)
    found = risk.score_map_risk(_boxes(s, d), _frames(s, d), "phase", cells, 12, 16, H, max_risk=0.5)
    return rounded(found.drop("peak_signal", "area_px"))


def _recurring(s, d):
    """Boxes moved together, so that they recur on a surface of 600 rows."""
    det = v.detections(s, d).where("frame_index < 400").selectExpr(
        "frame_index", "label", "bbox_top % 60 as bbox_top", "bbox_left % 40 as bbox_left", "bbox_top % 60 + 3 + label % 4 as bbox_bottom",
        "bbox_left % 40 + 4 as bbox_right", "case when label % 6 > 0 then peak_signal end as peak_signal", "10 + label as area_px",
    )
    phases = v.phases(s, d).where("frame_index < 400").selectExpr(
        "frame_index", "pmod(-59.25e0*frame_index, 600e0) as predicted_phase_px", "cast(floor(59.25e0*frame_index/600e0) as bigint) as revolution"
    )
    return det, phases


def artifact_exposure(s, d):
    det, phases = _recurring(s, d)
    return rounded(recurrence.artifact_map(det, phases, 600, 40, 1, 60, 2, 0.05, max_area=15))


def artifact_overlap(s, d):
    det, phases = _recurring(s, d)
    found = recurrence.artifact_map(det, phases, 600, 40, 0, 60, 3)
    out = recurrence.score_detections(det, phases, found, 600, 40, "soft", 0.2, 5.0, 1.5, max_area=14)
    return rounded(out.select("frame_index", "label", "overlap_fraction", "artifact_probability", "required_peak_signal", "rejected"))


def artifact_probabilities(s, d):
    det, phases = _recurring(s, d)
    found = recurrence.artifact_map(det, phases, 600, 40, 0, None, 3)
    out = recurrence.score_detections(det, phases, found, 600, 40, "probabilistic", 0.02, 5.0)
    return rounded(out.select("frame_index", "label", "overlap_fraction", "artifact_probability", "required_peak_signal", "rejected"), 5)


def artifact_leave_own_out(s, d):
    det, phases = _recurring(s, d)
    out = recurrence.score_leaving_own_out(det, phases, 600, 40, 1, 60, 4, 0.06)
    return rounded(out.select("frame_index", "label", "overlap_fraction", "artifact_probability", "rejected"))


def recurrence_tracks(s, d):
    det, phases = _recurring(s, d)
    points = det.selectExpr("frame_index div 5 * 3 + label % 3 as track_id", "frame_index", "(bbox_top + bbox_bottom - 1) * 0.5e0 as y", "(bbox_left + bbox_right - 1) * 0.5e0 as x")
    return rounded(recurrence.track_recurrence(points, phases, 60, 600, 4.0, 3.0, 3, 2, 2, 0.1), 5)


QUERIES = {
    f.__name__: f
    for f in (
        map_nearest, map_strip, map_trimmed, map_winsorized, map_gap_fill, map_gap_fill_strip, map_huber_weights, map_static, frame_zscores,
        average_background, row_counts, row_coverage, seam_profile, seam_summary, seam_at, map_roll, period_candidates, map_inpaint, ghost_marks,
        correction_smoothing, map_risk, render_views, render_strip, render_masks, map_support_risk, artifact_exposure, artifact_overlap,
        artifact_probabilities, artifact_leave_own_out, recurrence_tracks,
    )
}

_FRAMES = """, pixels AS (
  SELECT belt_row // 8 AS frame_index, belt_row % 8 AS y, x, CASE WHEN (belt_row * 7 + x) % 23 > 0 THEN v * 10 END AS v FROM belt_map WHERE belt_row < 200 AND x < 16
), frames AS (SELECT o_orderkey AS frame_index, o_orderkey * 3.25e0 AS phase FROM orders WHERE o_orderkey < 25)
"""
_SPLAT = (
    _FRAMES
    + """, pos AS (SELECT frame_index, x, v, (y + phase) % 40 AS a FROM pixels JOIN frames USING (frame_index) WHERE v IS NOT NULL),
  samples AS (SELECT frame_index, CAST(floor(a) AS BIGINT) % 40 AS belt_row, x, v, 1 - (a - floor(a)) AS w FROM pos
    UNION ALL SELECT frame_index, (CAST(floor(a) AS BIGINT) + 1) % 40, x, v, a - floor(a) FROM pos WHERE a > floor(a)),
  each_ AS (SELECT belt_row, x, frame_index, sum(w * v) / sum(w) AS v, sum(w) AS w FROM samples GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY belt_row, x ORDER BY v, frame_index) AS r, count(*) OVER c AS n,
    floor(count(*) OVER c * 0.2e0) AS k FROM each_ WINDOW c AS (PARTITION BY belt_row, x))
"""
)
_SMALL = ", small AS (SELECT * FROM belt_map WHERE belt_row < 200 AND x < 16)\n"
_JUMPS = """, j AS (SELECT s.r AS belt_row, avg(abs(a.v - b.v)) AS jump FROM range(200) s(r), range(8) t(i)
    JOIN small a ON a.belt_row = (s.r + i) % 200 JOIN small b ON b.belt_row = (s.r + i - 8 + 200) % 200 AND b.x = a.x GROUP BY 1)
"""
_SPARSE = """, sparse AS (SELECT *, belt_row % 3 + 1e0 AS support FROM belt_map
  WHERE belt_row < 200 AND x < 16 AND (belt_row * 5 + x * 3) % 11 < 4 AND x <> 3),
  grid AS (SELECT r AS belt_row, c AS x FROM range(200) a(r), range(16) b(c)),
  mean_ AS (SELECT sum(support * v) / sum(support) AS m FROM sparse)
"""


def _gaps(known: str) -> str:
    return CTES + _SPARSE + f""", k AS ({known}),
      lo AS (SELECT g.belt_row, g.x, max(k.r) AS r FROM grid g JOIN k ON k.x = g.x AND k.r <= g.belt_row GROUP BY ALL),
      hi AS (SELECT g.belt_row, g.x, min(k.r) AS r FROM grid g JOIN k ON k.x = g.x AND k.r >= g.belt_row GROUP BY ALL)
    SELECT g.belt_row, g.x, round(CASE WHEN a.v IS NULL AND b.v IS NULL THEN (SELECT m FROM mean_) WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v
        WHEN lo.r = hi.r THEN a.v ELSE a.v + (b.v - a.v) * (g.belt_row - lo.r) / (hi.r - lo.r) END, 6) AS v, coalesce(s.support, 0e0) AS support
    FROM grid g LEFT JOIN lo USING (belt_row, x) LEFT JOIN hi USING (belt_row, x) LEFT JOIN k a ON a.x = g.x AND a.r = lo.r
      LEFT JOIN k b ON b.x = g.x AND b.r = hi.r LEFT JOIN sparse s ON s.belt_row = g.belt_row AND s.x = g.x"""


_RISK = """, supported AS (SELECT belt_row, x, coalesce(CASE WHEN (belt_row + x) % 7 > 0 THEN (belt_row * 3 + x) % 4 * 0.75e0 END, 0e0) AS support FROM small),
  risk AS (SELECT *, support > 0 AS observed, support <= 0 AS interpolated, support < 2 AS low_support,
    CASE WHEN support > 0 THEN greatest(0e0, least(1e0, (2 - support) / 2)) ELSE 1e0 END AS risk FROM supported)
"""
_BOXES = """, boxes AS (SELECT frame_index, label, bbox_top % 14 - 2 AS bbox_top, bbox_left % 15 - 1 AS bbox_left, bbox_top % 14 + label % 3 AS bbox_bottom,
  bbox_left % 15 + 1 + label % 4 AS bbox_right, peak_signal FROM detections WHERE frame_index < 25)
"""
_RECURRING = """, det AS (SELECT frame_index, label, bbox_top % 60 AS t, bbox_left % 40 AS l, bbox_top % 60 + 3 + label % 4 AS b, bbox_left % 40 + 4 AS r,
    CASE WHEN label % 6 > 0 THEN peak_signal END AS peak_signal, 10 + label AS area_px FROM detections WHERE frame_index < 400),
  ph AS (SELECT frame_index, ((-59.25e0*frame_index) % 600e0 + 600e0) % 600e0 AS p, CAST(floor(59.25e0*frame_index/600e0) AS BIGINT) AS revolution
    FROM phases WHERE frame_index < 400),
  shown AS (SELECT DISTINCT revolution, CAST(floor(y + p + 0.5e0) AS BIGINT) % 600 AS belt_row FROM ph, range(60) q(y)),
  exposed AS (SELECT belt_row, count(*) AS e FROM shown GROUP BY 1),
  own AS (SELECT DISTINCT frame_index, label, revolution, CAST(floor(y + p + 0.5e0) AS BIGINT) % 600 AS belt_row, x
    FROM det JOIN ph USING (frame_index), range(80) q(y), range(40) c(x) WHERE y >= t AND y < b AND x >= l AND x < r)
"""


def _hits(margin: int, where: str = "true", rows: int = 60) -> str:
    return f""", hits AS (SELECT DISTINCT revolution, CAST(floor(y + p + 0.5e0) AS BIGINT) % 600 AS belt_row, x
      FROM det JOIN ph USING (frame_index), range({rows}) q(y), range(40) c(x)
      WHERE y >= t - {margin} AND y < b + {margin} AND x >= l - {margin} AND x < r + {margin} AND {where}),
    counts AS (SELECT belt_row, x, count(*) AS n FROM hits GROUP BY 1, 2)"""


ORACLE_SQL = {
    "map_nearest": CTES
    + _FRAMES
    + """SELECT CAST(floor(((y + phase) % 40) + 0.5e0) AS BIGINT) % 40 AS belt_row, x, round(avg(v), 6) AS v, CAST(count(*) AS DOUBLE) AS support
    FROM pixels JOIN frames USING (frame_index) WHERE v IS NOT NULL GROUP BY 1, 2""",
    "map_strip": CTES
    + _FRAMES
    + """, pos AS (SELECT x, v, least(greatest(y + phase, 0), 119) AS a FROM pixels JOIN frames USING (frame_index) WHERE v IS NOT NULL),
      s AS (SELECT CAST(floor(a) AS BIGINT) AS belt_row, x, v, 1 - (a - floor(a)) AS w FROM pos
        UNION ALL SELECT least(CAST(floor(a) AS BIGINT) + 1, 119), x, v, a - floor(a) FROM pos WHERE a > floor(a))
    SELECT belt_row, x, round(sum(w * v) / sum(w), 6) AS v, round(sum(w), 6) AS support FROM s GROUP BY 1, 2""",
    "map_trimmed": CTES
    + _SPLAT
    + "SELECT belt_row, x, round(sum(w * v) / sum(w), 6) AS v, round(sum(w), 6) AS support FROM ranked WHERE r > k AND r <= n - k GROUP BY 1, 2",
    "map_winsorized": CTES
    + _SPLAT
    + """, c AS (SELECT *, max(CASE WHEN r = k + 1 THEN v END) OVER w AS lo, max(CASE WHEN r = n - k THEN v END) OVER w AS hi FROM ranked WINDOW w AS (PARTITION BY belt_row, x))
    SELECT belt_row, x, round(sum(w * least(greatest(v, lo), hi)) / sum(w), 6) AS v, round(sum(w), 6) AS support FROM c GROUP BY 1, 2""",
    "map_gap_fill": _gaps("SELECT x, v, belt_row + d * 200 AS r FROM sparse, (VALUES (-1), (0), (1)) t(d)"),
    "map_gap_fill_strip": _gaps("SELECT x, v, belt_row AS r FROM sparse"),
    "map_huber_weights": CTES
    + _FRAMES
    + """, m AS (SELECT frame_index, median(v) AS m FROM pixels GROUP BY 1),
      s AS (SELECT frame_index, m, greatest(median(abs(v - m)) * 1.4826e0, 0.01e0) AS s FROM pixels JOIN m USING (frame_index) GROUP BY 1, 2)
    SELECT frame_index, y, x, round(CASE WHEN abs(v - m) > 1.5e0 * s THEN 1.5e0 * s / abs(v - m) ELSE 1e0 END, 6) AS weight
    FROM pixels JOIN s USING (frame_index) WHERE v IS NOT NULL""",
    "map_static": CTES
    + _FRAMES
    + """, m AS (SELECT y, x, median(v) AS m FROM pixels GROUP BY 1, 2)
    SELECT y, x, round(m, 6) AS background, round(greatest(median(abs(v - m)) * 1.4826e0, 1e-6), 6) AS noise FROM pixels JOIN m USING (y, x) GROUP BY y, x, m""",
    "frame_zscores": CTES
    + _FRAMES
    + """, m AS (SELECT frame_index, median(v) AS m FROM pixels GROUP BY 1),
      s AS (SELECT frame_index, m, greatest(median(abs(v - m)) * 1.4826e0, 0.01e0) AS s FROM pixels JOIN m USING (frame_index) GROUP BY 1, 2)
    SELECT frame_index, y, x, round(v - m, 6) AS raw, round((v - m) / s, 6) AS normalized FROM pixels JOIN s USING (frame_index) WHERE v IS NOT NULL""",
    "average_background": CTES
    + _FRAMES
    + "SELECT frame_index, y, x, round(v - m, 6) AS raw FROM pixels JOIN (SELECT y, x, avg(v) AS m FROM pixels GROUP BY 1, 2) USING (y, x) WHERE v IS NOT NULL",
    "row_counts": CTES
    + """SELECT CAST(floor(r + predicted_phase_px) AS BIGINT) % 14723 AS belt_row, count(*) AS n FROM phases, range(48) t(r) WHERE frame_index % 10 = 0 GROUP BY 1""",
    "row_coverage": CTES
    + """, a AS (SELECT r + predicted_phase_px AS a FROM phases, range(48) t(r) WHERE frame_index % 10 = 0)
    SELECT belt_row, round(sum(w), 6) AS exposure FROM (SELECT CAST(floor(a) AS BIGINT) % 14723 AS belt_row, 1 - (a - floor(a)) AS w FROM a
      UNION ALL SELECT (CAST(floor(a) AS BIGINT) + 1) % 14723, a - floor(a) FROM a) WHERE w > 0 GROUP BY 1""",
    "map_risk": CTES + _SMALL + _RISK + "SELECT belt_row, x, support, observed, interpolated, low_support, round(risk, 6) AS risk FROM risk",
    "map_roll": CTES
    + _SMALL
    + """SELECT shift, count(*) AS n, round(sqrt(avg((a.v - b.v) ** 2)), 6) AS rmse FROM (
      SELECT a.*, b.v AS o, ((b.belt_row + 37) % 200 - a.belt_row + 200) % 200 AS shift FROM small a JOIN small b ON a.x = b.x AND a.x < 4 AND (b.belt_row + b.x) % 5 > 0)
      GROUP BY 1 ORDER BY n DESC, rmse, shift LIMIT 1""".replace("(a.v - b.v)", "(v - o)"),
    "period_candidates": CTES
    + """, p AS (SELECT belt_row, avg(v) AS v FROM belt_map WHERE belt_row < 300 AND belt_row % 17 > 0 GROUP BY 1),
      c AS (SELECT belt_row, v - (SELECT avg(v) FROM p) AS v FROM p)
    SELECT lag, count(*) AS n, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) AS score
    FROM range(5, 121) t(lag), c a JOIN c b ON b.belt_row = a.belt_row + lag GROUP BY 1 HAVING n >= 2 ORDER BY score DESC, lag LIMIT 8""",
    "map_inpaint": CTES
    + _SMALL
    + """, holes AS (SELECT belt_row, x FROM small WHERE (belt_row * 3 + x) % 29 < 4),
      good AS (SELECT * FROM small WHERE (belt_row * 3 + x) % 29 >= 4),
      f AS (SELECT h.belt_row, h.x, median(g.v) AS n FROM holes h JOIN good g ON abs(g.x - h.x) <= 2 AND least((g.belt_row - h.belt_row + 200) % 200, (h.belt_row - g.belt_row + 200) % 200) <= 2
        GROUP BY 1, 2)
    SELECT s.belt_row, s.x, round(coalesce(n, CASE WHEN (s.belt_row * 3 + s.x) % 29 < 4 THEN (SELECT median(v) FROM small) END, v), 6) AS v
    FROM small s LEFT JOIN f USING (belt_row, x)""",
    "ghost_marks": CTES
    + """, m AS (SELECT CAST(floor((y + predicted_phase_px) % 14723e0) AS BIGINT) AS r, x FROM detections JOIN phases USING (frame_index), range(475) q(y), range(620) c(x)
        WHERE label = 1 AND y >= bbox_top - 1 AND y < least(bbox_bottom + 1, 470) AND x >= bbox_left - 1 AND x < bbox_right + 1),
      n AS (SELECT belt_row, x, count(*) AS n FROM (SELECT r % 14723 AS belt_row, x FROM m UNION ALL SELECT (r + 1) % 14723, x FROM m) GROUP BY 1, 2)
    SELECT *, round(n / (SELECT max(n) FROM n), 6) AS probability, true AS mask FROM n""",
    "correction_smoothing": CTES
    + """, k AS (SELECT frame_index // 200 AS run, frame_index % 200 AS f, correction_px AS c FROM phases WHERE frame_index < 600 AND frame_index % 4 > 0),
      g AS (SELECT run, f FROM (SELECT DISTINCT run FROM k), range(200) t(f)),
      i AS (SELECT g.run, g.f, (SELECT max(f) FROM k WHERE k.run = g.run AND k.f <= g.f) AS a, (SELECT min(f) FROM k WHERE k.run = g.run AND k.f >= g.f) AS b FROM g),
      v AS (SELECT i.run, i.f, CASE WHEN x.c IS NULL THEN y.c WHEN y.c IS NULL OR a = b THEN x.c ELSE x.c + (y.c - x.c) * (i.f - a) / (b - a) END AS v
        FROM i LEFT JOIN k x ON x.run = i.run AND x.f = a LEFT JOIN k y ON y.run = i.run AND y.f = b)
    SELECT run, f AS frame_index, round(median(v) OVER (PARTITION BY run ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM v""",
    "seam_profile": CTES + _SMALL + _JUMPS + "SELECT belt_row, round(jump, 6) AS jump FROM j",
    "seam_summary": CTES
    + _SMALL
    + _JUMPS
    + """SELECT round(c, 6) AS current_mean_abs_jump_gray, b AS best_roll_row, round(m, 6) AS best_mean_abs_jump_gray, round((c - m) / c, 6) AS relative_improvement,
      round(p, 6) AS p95_row_jump_gray, round(d, 6) AS median_row_jump_gray FROM (
      SELECT max(jump) FILTER (belt_row = 0) AS c, arg_min(belt_row, jump) AS b, min(jump) AS m, quantile_cont(jump, 0.95) AS p, median(jump) AS d FROM j)""",
    "seam_at": CTES
    + _SMALL
    + """SELECT 5 AS seam_row, round(avg(o) FILTER (i = 0), 6) AS mean_abs_jump_gray, round(quantile_cont(o, 0.95) FILTER (i = 0), 6) AS p95_abs_jump_gray,
      round(avg(o), 6) AS window_mean_abs_difference_gray FROM (
      SELECT i, abs(a.v - b.v) AS o FROM range(4) t(i) JOIN small a ON a.belt_row = 5 + i JOIN small b ON b.belt_row = (4 - i + 200) % 200 AND b.x = a.x)""",
    "render_views": CTES
    + _SMALL
    + _FRAMES
    + """, a AS (SELECT frame_index, y, (y + phase) % 200 AS a FROM frames, range(12) t(y))
    SELECT frame_index, y, s.x, round((1 - (a - floor(a))) * s.v + (a - floor(a)) * n.v, 6) AS v
    FROM a JOIN small s ON s.belt_row = floor(a) JOIN small n ON n.belt_row = (floor(a) + 1) % 200 AND n.x = s.x""",
    "render_strip": CTES
    + _SMALL
    + _FRAMES
    + """, a AS (SELECT frame_index, y, y + phase * 3 - 5 AS a FROM frames, range(12) t(y)), c AS (SELECT *, least(greatest(a, 0), 199) AS b FROM a)
    SELECT frame_index, y, s.x, CASE WHEN a BETWEEN 0 AND 199 THEN round((1 - (b - floor(b))) * s.v + (b - floor(b)) * n.v, 6) END AS v
    FROM c JOIN small s ON s.belt_row = floor(b) JOIN small n ON n.belt_row = least(floor(b) + 1, 199) AND n.x = s.x""",
    "render_masks": CTES
    + _SMALL
    + _FRAMES
    + """, a AS (SELECT frame_index, y, CAST(floor((y + phase) % 200) AS BIGINT) AS r FROM frames, range(12) t(y))
    SELECT frame_index, y, x, bool_or((belt_row * 3 + x) % 5 = 0) AS mask FROM a JOIN small ON belt_row = r OR belt_row = (r + 1) % 200 GROUP BY 1, 2, 3""",
    "map_support_risk": CTES
    + _SMALL
    + _FRAMES
    + _RISK
    + _BOXES
    + """, px AS (SELECT b.frame_index, label, y, c.x, (y + phase) % 200 AS a FROM boxes b JOIN frames USING (frame_index), range(12) q(y), range(16) c(x)
        WHERE y >= bbox_top AND y < bbox_bottom AND c.x >= bbox_left AND c.x < bbox_right),
      s AS (SELECT p.frame_index, p.label, a - floor(a) AS w, m.support AS s0, n.support AS s1, m.risk AS r0, n.risk AS r1, CAST(m.interpolated AS INT) AS i0,
          CAST(n.interpolated AS INT) AS i1, CAST(m.low_support AS INT) AS l0, CAST(n.low_support AS INT) AS l1
        FROM px p JOIN risk m ON m.belt_row = floor(a) AND m.x = p.x JOIN risk n ON n.belt_row = (floor(a) + 1) % 200 AND n.x = p.x),
      f AS (SELECT frame_index, label, min((1-w)*s0+w*s1) AS map_support_min, avg((1-w)*s0+w*s1) AS map_support_mean, avg((1-w)*r0+w*r1) AS map_risk_mean,
          max((1-w)*r0+w*r1) AS map_risk_max, avg((1-w)*i0+w*i1) AS map_interpolated_fraction, avg((1-w)*l0+w*l1) AS map_low_support_fraction FROM s GROUP BY 1, 2)
    SELECT frame_index, label, bbox_top, bbox_left, bbox_bottom, bbox_right, round(map_support_min, 6) AS map_support_min, round(map_support_mean, 6) AS map_support_mean,
      round(map_risk_mean, 6) AS map_risk_mean, round(map_risk_max, 6) AS map_risk_max, round(map_interpolated_fraction, 6) AS map_interpolated_fraction,
      round(map_low_support_fraction, 6) AS map_low_support_fraction, coalesce(map_risk_mean > 0.5e0, false) AS rejected FROM boxes LEFT JOIN f USING (frame_index, label)""",
    "artifact_exposure": CTES
    + _RECURRING
    + _hits(1, "area_px <= 15")
    + """SELECT belt_row, x, n AS counts, e AS exposures, round(n / e, 6) AS probability, n >= 2 AND n / e >= 0.05e0 AS mask FROM counts JOIN exposed USING (belt_row)""",
    "artifact_overlap": CTES
    + _RECURRING
    + _hits(0)
    + """, s AS (SELECT frame_index, label, avg(CASE WHEN n >= 3 THEN 1e0 ELSE 0e0 END) AS o FROM own LEFT JOIN counts USING (belt_row, x) GROUP BY 1, 2)
    SELECT frame_index, label, round(coalesce(o, 0), 6) AS overlap_fraction, round(coalesce(o, 0), 6) AS artifact_probability,
      round(5 * (1 + 1.5e0 * coalesce(o, 0)), 6) AS required_peak_signal,
      coalesce(o, 0) > 0.2e0 AND area_px <= 14 AND coalesce(peak_signal <= 5 * (1 + 1.5e0 * coalesce(o, 0)), true) AS rejected
    FROM det LEFT JOIN s USING (frame_index, label)""",
    "artifact_probabilities": CTES
    + _RECURRING
    + _hits(0, rows=80)
    + """, q AS (SELECT belt_row, x, CAST(CAST(n / (SELECT count(DISTINCT revolution) FROM ph) AS FLOAT) AS DOUBLE) AS q FROM counts WHERE n >= 3),
      s AS (SELECT frame_index, label, avg(CASE WHEN q > 0 THEN 1e0 ELSE 0e0 END) AS o, avg(coalesce(q, 0)) AS p FROM own LEFT JOIN q USING (belt_row, x) GROUP BY 1, 2)
    SELECT frame_index, label, round(coalesce(o, 0), 5) AS overlap_fraction, round(coalesce(p, 0), 5) AS artifact_probability, round(5 * (1 + coalesce(p, 0)), 5) AS required_peak_signal,
      coalesce(p, 0) > 0.02e0 AND coalesce(peak_signal <= 5 * (1 + coalesce(p, 0)), true) AS rejected FROM det LEFT JOIN s USING (frame_index, label)""",
    "artifact_leave_own_out": CTES
    + _RECURRING
    + _hits(1)
    + """, c AS (SELECT o.frame_index, o.label, coalesce(n, 0) - CASE WHEN h.x IS NULL THEN 0 ELSE 1 END AS n, coalesce(e, 0) - CASE WHEN w.belt_row IS NULL THEN 0 ELSE 1 END AS e
        FROM own o LEFT JOIN counts USING (belt_row, x) LEFT JOIN exposed USING (belt_row)
          LEFT JOIN hits h ON h.revolution = o.revolution AND h.belt_row = o.belt_row AND h.x = o.x LEFT JOIN shown w ON w.revolution = o.revolution AND w.belt_row = o.belt_row),
      s AS (SELECT frame_index, label, avg(CASE WHEN n >= 3 AND CASE WHEN e > 0 THEN n / e ELSE 0 END >= 0.06e0 THEN 1e0 ELSE 0e0 END) AS o FROM c GROUP BY 1, 2)
    SELECT frame_index, label, round(coalesce(o, 0), 6) AS overlap_fraction, round(coalesce(o, 0), 6) AS artifact_probability, coalesce(o, 0) > 0.3e0 AS rejected
    FROM det LEFT JOIN s USING (frame_index, label)""",
    "recurrence_tracks": CTES
    + _RECURRING
    + """, pts AS (SELECT frame_index // 5 * 3 + label % 3 AS track_id, frame_index, (t + b - 1) * 0.5e0 AS y, (l + r - 1) * 0.5e0 AS x FROM det),
      pl AS (SELECT pts.*, p, revolution, (y + p) % 600 AS yb FROM pts JOIN ph USING (frame_index)),
      ce AS (SELECT track_id, CASE WHEN sqrt(pow(avg(cos(yb * pi() / 300)), 2) + pow(avg(sin(yb * pi() / 300)), 2)) > 1e-12
          THEN ((atan2(avg(sin(yb * pi() / 300)), avg(cos(yb * pi() / 300))) + 2 * pi()) % (2 * pi())) * 300 / pi() END AS cy, avg(x) AS cx, stddev_pop(x) AS sx,
          count(*) AS n, min(frame_index) AS f0, max(frame_index) AS f1, count(DISTINCT revolution) AS sr FROM pl GROUP BY 1),
      rm AS (SELECT track_id, sqrt(avg(pow(least(abs(yb - cy), 600 - abs(yb - cy)), 2))) AS rms FROM pl JOIN ce USING (track_id) GROUP BY 1),
      sf AS (SELECT DISTINCT track_id, revolution FROM pl),
      ex AS (SELECT DISTINCT track_id, revolution FROM ce, ph WHERE ((cy - p) % 600 + 600) % 600 < 60 AND (track_id, revolution) NOT IN (SELECT track_id, revolution FROM sf)),
      hi AS (SELECT c.track_id, count(DISTINCT o.revolution) AS hr, count(*) AS hd FROM ce c JOIN pl o ON o.track_id <> c.track_id AND abs(o.x - cx) <= 3
          AND least(abs(o.yb - cy), 600 - abs(o.yb - cy)) <= 4 JOIN ex e ON e.track_id = c.track_id AND e.revolution = o.revolution GROUP BY 1),
      ec AS (SELECT track_id, count(*) AS er FROM ex GROUP BY 1),
      al AS (SELECT *, coalesce(er, 0) AS e, coalesce(hr, 0) AS h, coalesce(hd, 0) AS d, CASE WHEN coalesce(er, 0) > 0 THEN coalesce(hr, 0) / er ELSE 0e0 END AS fr
        FROM ce LEFT JOIN rm USING (track_id) LEFT JOIN ec USING (track_id) LEFT JOIN hi USING (track_id))
    SELECT track_id, n AS n_detections, f0 AS frame_start, f1 AS frame_end, round(cy, 5) AS belt_y_center_px, round(cx, 5) AS belt_x_center_px, round(rms, 5) AS belt_y_rms_px,
      round(sx, 5) AS belt_x_std_px, sr AS self_revolution_count, e AS other_exposed_revolutions, h AS other_hit_revolutions, d AS other_hit_detections,
      round(fr, 5) AS recurrence_fraction, round(least(1e0, h / 2, d / 2, fr / 0.1e0), 5) AS recurrence_score, n >= 3 AND h >= 2 AND d >= 2 AND fr >= 0.1e0 AS rejected,
      CASE WHEN n >= 3 AND h >= 2 AND d >= 2 AND fr >= 0.1e0 THEN 'other detections recur at this belt coordinate in exposed revolutions'
        WHEN e = 0 THEN 'no other belt revolution exposed this coordinate' WHEN h = 0 THEN 'belt-fixed track, but no leave-track-out recurrence'
        ELSE 'weak recurrence evidence below runtime filter threshold' END AS causal_read FROM al""",
}
