"""What recurs on the surface: artifact maps, detections and tracks scored against other revolutions.

Phases have frame_index, a phase column and revolution; detections have frame_index, label and a box.
Maps are sparse: cells (belt_row, x) that some detection has hit.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopsight.functions import cyclic

PHASE = "predicted_phase_px"


def _numbers(low: Column, high: Column) -> Column:
    """low to high - 1, or nothing."""
    return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))


def _rows(top: Column, bottom: Column, phase: Column, height: int) -> Column:
    """Distinct surface rows of image rows top to bottom - 1, each rounded half up."""
    rows = F.transform(_numbers(top.cast("long"), bottom.cast("long")), lambda r: F.pmod(F.floor(r + phase + 0.5), F.lit(height)))
    return F.array_distinct(rows)


def _cells(boxes: DataFrame, keep: list[str], height: int, width: int, margin: int = 0, frame_height: int | None = None) -> DataFrame:
    """keep and (belt_row, x) of each cell under each box, grown by margin and cut at the image's upper and lateral edges.

    Rows below frame_height are cut too where that's given.
    """
    top = F.greatest(F.col("bbox_top") - margin, F.lit(0))
    bottom = F.col("bbox_bottom") + margin
    bottom = bottom if frame_height is None else F.least(bottom, F.lit(frame_height))
    columns = _numbers(F.greatest(F.col("bbox_left") - margin, F.lit(0)).cast("long"), F.least(F.col("bbox_right") + margin, F.lit(width)).cast("long"))
    out = boxes.select(*keep, F.explode(_rows(top, bottom, F.col(PHASE), height)).alias("belt_row"), columns.alias("xs"))
    return out.select(*keep, "belt_row", F.explode("xs").alias("x"))


def candidates(detections: DataFrame, max_area: float | None = None, max_peak: float | None = None) -> DataFrame:
    """Detections small and faint enough to be an artifact; with a limit on the peak, missing peaks don't pass."""
    out = detections
    if max_area is not None:
        out = out.where(F.col("area_px") <= max_area)
    if max_peak is not None:
        out = out.where(cyclic.finite(F.col("peak_signal").cast("double")) <= max_peak)
    return out


def _hits(detections: DataFrame, phases: DataFrame, height: int, width: int, margin: int, frame_height: int | None) -> DataFrame:
    """Distinct (revolution, belt_row, x) that detections hit."""
    met = detections.join(phases.select("frame_index", PHASE, "revolution"), "frame_index")
    return _cells(met, ["revolution"], height, width, margin, frame_height).distinct()


def _exposures(phases: DataFrame, height: int, frame_height: int) -> DataFrame:
    """Distinct (revolution, belt_row) that frames show."""
    rows = _rows(F.lit(0), F.lit(frame_height), F.col(PHASE), height)
    return phases.select("revolution", F.explode(rows).alias("belt_row")).distinct()


def probability(counts: Column, exposures: Column) -> Column:
    """Hits over exposures; 0 where nothing was exposed."""
    return F.when(exposures > 0, counts / exposures).otherwise(0.0)


def artifact_map(
    detections: DataFrame, phases: DataFrame, height: int, width: int, margin: int = 2, frame_height: int | None = None,
    min_revolutions: int = 1, min_probability: float = 0.0, max_area: float | None = None, max_peak: float | None = None,
) -> DataFrame:
    """belt_row, x, counts, exposures, probability, mask of each cell that was hit.

    counts are distinct revolutions with a hit, exposures those that showed the row (all of them
    without a frame height).
    """
    hits = _hits(candidates(detections, max_area, max_peak), phases, height, width, margin, frame_height)
    counts = hits.groupBy("belt_row", "x").agg(F.count(F.lit(1)).alias("counts"))
    if frame_height is None:
        out = counts.join(phases.agg(F.countDistinct("revolution").alias("exposures")))  # one row
    else:
        shown = _exposures(phases, height, frame_height).groupBy("belt_row").agg(F.count(F.lit(1)).alias("exposures"))
        out = counts.join(shown, "belt_row", "left").withColumn("exposures", F.coalesce("exposures", F.lit(0)))
    out = out.withColumn("probability", probability(F.col("counts"), F.col("exposures")))
    mask = (F.col("counts") >= min_revolutions) & (F.col("probability") >= min_probability)
    return out.select("belt_row", "x", "counts", "exposures", "probability", mask.alias("mask"))


def _decided(cells: DataFrame, detections: DataFrame, prior: Column, mode: str, max_overlap: float, threshold: float | None,
             weight: float, max_area: float | None, max_peak: float | None) -> DataFrame:
    """detections with the share of their cells that have a prior, its mean, the peak required and whether they're rejected."""
    if mode not in ("hard", "soft", "probabilistic"):
        raise ValueError("mode is hard, soft or probabilistic")
    if mode != "hard" and threshold is None:
        raise ValueError("soft and probabilistic filtering need a threshold")
    p = F.coalesce(prior, F.lit(0.0))
    found = cells.groupBy("frame_index", "label").agg(F.avg((p > 0).cast("double")).alias("overlap_fraction"), F.avg(p).alias("artifact_probability"))
    out = detections.join(found, ["frame_index", "label"], "left").fillna(0.0, ["overlap_fraction", "artifact_probability"])
    value = F.col("artifact_probability" if mode == "probabilistic" else "overlap_fraction")
    needed = F.lit(None).cast("double") if mode == "hard" else F.lit(float(threshold)) * (1 + weight * value)
    peak = cyclic.finite(F.col("peak_signal").cast("double"))
    may = F.lit(True)
    if max_area is not None:
        may = may & F.coalesce(F.col("area_px") <= max_area, F.lit(False))
    if max_peak is not None:
        may = may & F.coalesce(peak <= max_peak, F.lit(False))
    weak = F.lit(True) if mode == "hard" else F.coalesce(peak <= needed, F.lit(True))
    return out.withColumns({"required_peak_signal": needed, "rejected": (value > max_overlap) & may & weak})


def score_detections(
    detections: DataFrame, phases: DataFrame, artifacts: DataFrame, height: int, width: int, mode: str = "hard", max_overlap: float = 0.3,
    threshold: float | None = None, weight: float = 1.0, max_area: float | None = None, max_peak: float | None = None,
) -> DataFrame:
    """detections with overlap_fraction, artifact_probability, required_peak_signal and rejected, against a given artifact map.

    The prior of a cell is 1, or its probability in probabilistic mode, where the map's mask holds.
    A box without cells has 0. Rows of the box are not cut at the frame's lower edge.
    """
    met = detections.join(phases.select("frame_index", PHASE), "frame_index")
    cells = _cells(met, ["frame_index", "label"], height, width)
    prior = F.col("probability").cast("float").cast("double") if mode == "probabilistic" else F.lit(1.0)
    known = artifacts.where("mask").select("belt_row", "x", prior.alias("prior"))
    return _decided(cells.join(known, ["belt_row", "x"], "left"), detections, F.col("prior"), mode, max_overlap, threshold, weight, max_area, max_peak)


def score_leaving_own_out(
    detections: DataFrame, phases: DataFrame, height: int, width: int, margin: int = 2, frame_height: int | None = None,
    min_revolutions: int = 1, min_probability: float = 0.0, mode: str = "hard", max_overlap: float = 0.3, threshold: float | None = None,
    weight: float = 1.0, candidate_area: float | None = None, candidate_peak: float | None = None, max_area: float | None = None,
    max_peak: float | None = None,
) -> DataFrame:
    """score_detections against what other revolutions than the detection's own have hit.

    A detection's own revolution is taken out of counts and exposures, so nothing rejects itself;
    max(1, min_revolutions - 1) others are needed.
    """
    likely = candidates(detections, candidate_area, candidate_peak)
    hits = _hits(likely, phases, height, width, margin, frame_height)
    counts = hits.groupBy("belt_row", "x").agg(F.count(F.lit(1)).alias("counts"))
    met = detections.join(phases.select("frame_index", PHASE, "revolution"), "frame_index")
    cells = _cells(met, ["frame_index", "label", "revolution"], height, width).join(counts, ["belt_row", "x"])
    cells = cells.join(hits.withColumn("own", F.lit(1)), ["revolution", "belt_row", "x"], "left")
    others = F.greatest(F.col("counts") - F.coalesce("own", F.lit(0)), F.lit(0))
    if frame_height is None:
        cells = cells.join(phases.agg(F.countDistinct("revolution").alias("exposures"))).withColumn("shown", F.lit(1))
    else:
        shown = _exposures(phases, height, frame_height)
        totals = shown.groupBy("belt_row").agg(F.count(F.lit(1)).alias("exposures"))
        cells = cells.join(totals, "belt_row", "left").join(shown.withColumn("shown", F.lit(1)), ["revolution", "belt_row"], "left")
    exposed = F.greatest(F.coalesce("exposures", F.lit(0)) - F.coalesce("shown", F.lit(0)), F.lit(0))
    chance = probability(others, exposed)
    known = (others >= max(1, min_revolutions - 1)) & (chance >= min_probability)
    prior = F.when(known, chance if mode == "probabilistic" else F.lit(1.0)).otherwise(0.0)
    every = _cells(met, ["frame_index", "label"], height, width)
    priors = cells.select("frame_index", "label", "belt_row", "x", prior.alias("prior")).where("prior > 0")
    joined = every.join(priors, ["frame_index", "label", "belt_row", "x"], "left")
    return _decided(joined, detections, F.col("prior"), mode, max_overlap, threshold, weight, max_area, max_peak)


def _band(value: Column, period: float, radius: float) -> tuple[Column, Column]:
    """(bucket, buckets to ask) of a cyclic coordinate: what lies within radius lies in one of those asked."""
    n = max(1, int(period // max(radius, 1.0)))
    bucket = F.least(F.floor(value / (period / n)), F.lit(n - 1))
    return bucket, F.array_distinct(F.array(*[F.pmod(bucket + i, F.lit(n)) for i in (-1, 0, 1)]))


def track_recurrence(
    points: DataFrame, phases: DataFrame, frame_height: float, height: float, radius_y: float = 8.0, radius_x: float = 8.0,
    min_detections: int = 5, min_revolutions: int = 2, min_hits: int = 2, min_fraction: float = 1.0,
) -> DataFrame:
    """Each track's recurrence in other revolutions: what else lies near its place on the surface when that's shown again.

    points are (track_id, frame_index, y, x). A track's place is the circular mean of its surface rows
    and the mean of its x; it's exposed in a revolution that has a frame showing that row. Bands of
    the surface are the join keys, so only neighbours meet.
    """
    frames = phases.select("frame_index", PHASE, "revolution")
    placed = points.join(frames, "frame_index").withColumn("belt_y", cyclic.surface_row(F.col("y"), F.col(PHASE), height))
    centre = placed.groupBy("track_id").agg(cyclic.circular_mean(F.col("belt_y"), height).alias("belt_y_center_px"), F.avg("x").alias("belt_x_center_px"))
    extent = points.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_detections"), F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end")
    )
    tracks = extent.join(centre, "track_id", "left")
    own = placed.select("track_id", "revolution").distinct()
    spread = placed.join(centre, "track_id").groupBy("track_id").agg(
        F.sqrt(F.avg(F.pow(cyclic.circular_distance(F.col("belt_y"), F.col("belt_y_center_px"), height), F.lit(2.0)))).alias("belt_y_rms_px"),
        F.stddev_pop("x").alias("belt_x_std_px"),
    )
    here = tracks.select("track_id", F.col("belt_y_center_px").alias("cy"), F.col("belt_x_center_px").alias("cx")).where("cy is not null")
    # a frame shows the bands from its phase on, one band being as high as a frame
    n = max(1, int(height // max(frame_height, 1.0)))
    size = height / n
    bands = F.transform(F.sequence(F.lit(0), F.lit(int(frame_height // size) + 2)), lambda i: F.pmod(F.floor(F.pmod(F.col(PHASE), F.lit(float(height))) / size) + i, F.lit(n)))
    shown = frames.select(PHASE, "revolution", F.explode(F.array_distinct(bands)).alias("band"))
    exposed = here.withColumn("band", F.least(F.floor(F.col("cy") / size), F.lit(n - 1))).join(shown, "band")
    exposed = exposed.where(cyclic.visible(F.col("cy"), F.col(PHASE), frame_height, height)).select("track_id", "revolution").distinct()
    exposed = exposed.join(own, ["track_id", "revolution"], "left_anti")
    at, asked = _band(F.col("belt_y"), height, radius_y)
    others = placed.select(F.col("track_id").alias("other"), "revolution", "belt_y", "x", at.alias("band"))
    _, asked = _band(F.col("cy"), height, radius_y)
    near = here.select("track_id", "cy", "cx", F.explode(asked).alias("band")).join(others, "band")
    near = near.where(
        (F.col("other") != F.col("track_id")) & (F.abs(F.col("x") - F.col("cx")) <= radius_x)
        & (cyclic.circular_distance(F.col("belt_y"), F.col("cy"), height) <= radius_y)
    ).join(exposed, ["track_id", "revolution"], "left_semi")
    hits = near.groupBy("track_id").agg(F.countDistinct("revolution").alias("other_hit_revolutions"), F.count(F.lit(1)).alias("other_hit_detections"))
    counts = exposed.groupBy("track_id").agg(F.count(F.lit(1)).alias("other_exposed_revolutions"))
    self_ = own.groupBy("track_id").agg(F.count(F.lit(1)).alias("self_revolution_count"))
    out = tracks.join(spread, "track_id", "left").join(self_, "track_id", "left").join(counts, "track_id", "left").join(hits, "track_id", "left")
    out = out.fillna(0, ["self_revolution_count", "other_exposed_revolutions", "other_hit_revolutions", "other_hit_detections"])
    revolutions, found = F.col("other_hit_revolutions"), F.col("other_hit_detections")
    fraction = F.when(F.col("other_exposed_revolutions") > 0, revolutions / F.col("other_exposed_revolutions")).otherwise(0.0)
    out = out.withColumn("recurrence_fraction", fraction)
    score = F.least(
        F.lit(1.0), revolutions / max(1, min_revolutions), found / max(1, min_hits), F.col("recurrence_fraction") / max(min_fraction, 1e-12)
    )
    rejected = (
        (F.col("n_detections") >= min_detections) & (revolutions >= min_revolutions) & (found >= min_hits)
        & (F.col("recurrence_fraction") >= min_fraction)
    )
    placeless = F.col("belt_y_center_px").isNull()
    read = (
        F.when(placeless, "track has no belt-coordinate center")
        .when(rejected, "other detections recur at this belt coordinate in exposed revolutions")
        .when(F.col("other_exposed_revolutions") == 0, "no other belt revolution exposed this coordinate")
        .when(revolutions == 0, "belt-fixed track, but no leave-track-out recurrence")
        .otherwise("weak recurrence evidence below runtime filter threshold")
    )
    return out.withColumns({"recurrence_score": score, "rejected": rejected & ~placeless, "causal_read": read})
