"""Detections, score curves and tracklets measured against truth."""

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopsight.functions import boxes
from loopsight.functions.cyclic import finite
from loopsight.operators.assignment import optimal_matches
from loopsight.operators.ordered import ranks, running


def _one(*parts: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)
    return out


def matched_boxes(detections: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """matches with centroid_error_px, the distance of the detection's centroid (else its box's middle) from the truth's middle."""
    y = F.col("y").cast("double") if "y" in detections.columns else F.lit(None).cast("double")
    x = F.col("x").cast("double") if "x" in detections.columns else F.lit(None).cast("double")
    at = boxes.centre(boxes.sides("bbox_"), y, x)
    found = detections.select("frame_index", "label", at[0].alias("dy"), at[1].alias("dx"))
    middle = boxes.middle(boxes.sides("t_"))
    sought = truth.select("frame_index", "truth_id", middle[0].alias("ty"), middle[1].alias("tx"))
    met = matches.join(found, ["frame_index", "label"]).join(sought, ["frame_index", "truth_id"])
    return met.withColumn("centroid_error_px", F.hypot(F.col("dy") - F.col("ty"), F.col("dx") - F.col("tx"))).drop("dy", "dx", "ty", "tx")


def frame_outcomes(detections: DataFrame, truth: DataFrame, matches: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """frame_index, tp, fp, fn of each scored frame (those given, else all with a box of either kind).

    Boxes are counted in one aggregation: joins of counts by frame would be broadcast where files are small for their rows.
    """
    one, no = F.col("frame_index").isNotNull().cast("long"), F.lit(0).cast("long")
    kinds = [(detections, frames is None, "nd"), (truth, frames is None, "nt"), (matches, False, "tp")]
    if frames is not None:
        kinds.append((frames, True, None))
    rows = [df.select("frame_index", F.lit(asked).alias("asked"), *[(one if c == kind else no).alias(c) for c in ("nd", "nt", "tp")]) for df, asked, kind in kinds]
    out = functools.reduce(DataFrame.union, rows).groupBy("frame_index").agg(F.max("asked").alias("asked"), *[F.sum(c).alias(c) for c in ("nd", "nt", "tp")])
    return out.where("asked").select("frame_index", "tp", (F.col("nd") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"))


def outcome_scores(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of tp, fp and fn, with precision, recall and F1; by the columns given, else one row."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    out = outcomes.groupBy(*by).agg(*sums) if by else outcomes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    args = [F.col(c) for c in ("tp", "fp", "fn")]
    out = out.withColumn("precision", boxes.precision(*args)).withColumn("recall", boxes.recall(*args))
    return out.withColumn("f1", boxes.f1(F.col("precision"), F.col("recall")))


def detection_metrics(detections: DataFrame, truth: DataFrame, least: float = 0.25, frames: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """One row: outcomes over scored frames, scores, mean IoU and centroid error of the matches.

    Unless matches are given, each frame's boxes are matched to the most pairs, then the largest total IoU.
    """
    if frames is not None:
        detections, truth = (x.join(frames.select("frame_index").distinct(), "frame_index", "left_semi") for x in (detections, truth))
    matches = optimal_matches(detections, truth, least) if matches is None else matches
    errors = matched_boxes(detections, truth, matches).agg(F.avg("iou").alias("mean_iou"), F.avg("centroid_error_px").alias("mean_centroid_error_px"))
    return _one(outcome_scores(frame_outcomes(detections, truth, matches, frames)), errors)


def roles(detections: DataFrame, matches: DataFrame) -> DataFrame:
    """detections with role: TP where matched, else FP."""
    return detections.join(matches.select("frame_index", "label", F.lit("TP").alias("role")), ["frame_index", "label"], "left").fillna("FP", ["role"])


def monotone_points(points: DataFrame) -> DataFrame:
    """fp_per_frame, recall: the best recall at each distinct rate of false detections or below; points missing either are left out."""
    known = points.select(finite(F.col("fp_per_frame")).alias("fp_per_frame"), finite(F.col("recall")).alias("recall")).dropna()
    best = known.groupBy("fp_per_frame").agg(F.greatest(F.max("recall"), F.lit(0.0)).alias("recall"))
    return running(best, ["fp_per_frame"], tops={"best": F.col("recall")}).select("fp_per_frame", F.col("best").alias("recall"))


def recall_at(points: DataFrame, most: float) -> DataFrame:
    """One row: the best recall with at most so many false detections a frame; 0 if there's none, null without points."""
    found = monotone_points(points).agg(F.max(F.when(F.col("fp_per_frame") <= most, F.col("recall"))).alias("r"), F.count(F.lit(1)).alias("n"))
    return found.select(F.when(F.col("n") > 0, F.coalesce("r", F.lit(0.0))).alias("recall"))


def area_up_to(points: DataFrame, most: float) -> DataFrame:
    """One row: the area under the envelope from no recall at no false detections up to `most`, as a share of the whole."""
    envelope = monotone_points(points).where((F.col("fp_per_frame") >= 0) & (F.col("fp_per_frame") <= most))
    start = points.sparkSession.createDataFrame([(0.0, 0.0)], "fp_per_frame double, recall double")
    all_ = start.unionByName(envelope).groupBy("fp_per_frame").agg(F.max("recall").alias("recall"))
    w = Window.orderBy("fp_per_frame")
    step = F.coalesce(F.lead("fp_per_frame").over(w), F.lit(float(most))) - F.col("fp_per_frame")
    height = (F.col("recall") + F.coalesce(F.lead("recall").over(w), F.col("recall"))) / 2
    area = all_.select((step * height).alias("a")).agg((F.sum("a") / most).alias("area"))
    n = monotone_points(points).agg(F.count(F.lit(1)).alias("n"))
    return _one(area, n).select(F.when((F.col("n") > 0) & F.lit(most > 0), F.col("area")).alias("area"))


def thresholds(scores: DataFrame, most: int | None) -> DataFrame:
    """threshold: distinct finite scores; beyond `most` of them the upper half of that many, and the rest spread evenly over those below."""
    unique = scores.select(finite(F.col("score").cast("double")).alias("threshold")).dropna().distinct()
    if not most or most <= 0:
        return unique
    n = unique.count()
    if n <= most:
        return unique
    ranked = ranks(unique, [F.desc("threshold")]).withColumnRenamed("rank", "i")
    if most == 1:
        return ranked.where("i = 0").select("threshold")
    head = max(1, most // 2)
    slots = most - head
    tail = {int(round(head + (n - 1 - head) * k / (slots - 1))) if slots > 1 else head for k in range(slots)}
    return ranked.where((F.col("i") < head) | F.col("i").isin(sorted(tail))).select("threshold")


def score_column(rows: DataFrame, names: list[str]) -> str | None:
    """The column with the most finite numbers, the first of equals; None where none has any."""
    known = [n for n in names if n in rows.columns]
    if not known:
        return None
    counts = rows.agg(*[F.count(finite(F.col(n).try_cast("double"))).alias(n) for n in known]).first()
    best = max(known, key=lambda n: counts[n])
    return best if counts[best] else None


def frame_denominator(detections: DataFrame, truth_frames: DataFrame) -> DataFrame:
    """One row: how many frames are scored or have a detection."""
    return detections.select("frame_index").union(truth_frames.select("frame_index")).agg(F.countDistinct("frame_index").alias("frames"))


def identity_switches(matches: DataFrame) -> DataFrame:
    """tracklet_id, switches: how often the matched track of a truth tracklet differs from the one before."""
    w = Window.partitionBy("tracklet_id").orderBy("frame_index")
    changed = matches.withColumn("changed", F.coalesce(F.col("track_id") != F.lag("track_id").over(w), F.lit(False)))
    return changed.groupBy("tracklet_id").agg(F.count_if("changed").alias("switches"))


def fragments(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """tracklet_id, segments: runs of matched boxes along each truth tracklet."""
    met = truth.join(matches.select("tracklet_id", "frame_index", F.lit(True).alias("hit")), ["tracklet_id", "frame_index"], "left").fillna(False, ["hit"])
    w = Window.partitionBy("tracklet_id").orderBy("frame_index")
    begins = F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False))
    return met.withColumn("begins", begins).groupBy("tracklet_id").agg(F.count_if("begins").alias("segments"))


def evaluate_tracklets(truth: DataFrame, predictions: DataFrame, matches: DataFrame, frames: DataFrame) -> DataFrame:
    """One row of counts and rates for tracklets on scored frames.

    truth is (tracklet_id, frame_index), predictions (track_id, frame_index), one row a box; matches are
    (tracklet_id, track_id, frame_index, iou, centroid_error_px). det_a, ass_a, loc_a and hota are of one IoU threshold.
    """
    scored = frames.select("frame_index").union(truth.select("frame_index")).distinct()
    predictions = predictions.join(scored, "frame_index", "left_semi")
    counts = _one(
        matches.agg(F.count(F.lit(1)).alias("true_positives"), F.avg("iou").alias("loc_a"), F.avg("centroid_error_px").alias("mean_centroid_error_px"),
                    F.countDistinct("tracklet_id").alias("matched_truth_tracklets"), F.countDistinct("track_id").alias("matched_predicted_tracklets")),
        truth.agg(F.count(F.lit(1)).alias("truth_boxes"), F.countDistinct("tracklet_id").alias("truth_tracklets")),
        predictions.agg(F.count(F.lit(1)).alias("predicted_boxes"), F.countDistinct("track_id").alias("predicted_tracklets")),
        scored.agg(F.count(F.lit(1)).alias("scored_frames")),
        predictions.join(truth, "frame_index", "left_anti").agg(F.count(F.lit(1)).alias("false_positives_on_empty_scored_frames")),
    )
    per_truth = truth.groupBy("tracklet_id").agg(F.count(F.lit(1)).alias("nt"))
    per_track = predictions.groupBy("track_id").agg(F.count(F.lit(1)).alias("np"))
    pairs = matches.groupBy("tracklet_id", "track_id").agg(F.count(F.lit(1)).alias("tpa"))
    scored_pairs = pairs.join(per_truth, "tracklet_id").join(per_track, "track_id")
    tpa, n = F.col("tpa"), F.sum("tpa")
    mean = lambda value: F.sum(tpa * value) / n
    association = scored_pairs.agg(
        mean(tpa / (F.col("nt") + F.col("np") - tpa)).alias("ass_a"), mean(tpa / F.col("np")).alias("ass_pr"), mean(tpa / F.col("nt")).alias("ass_re")
    )
    merged = pairs.groupBy("track_id").agg(F.count(F.lit(1)).alias("k"), F.max("tpa").alias("best"))
    split = pairs.groupBy("tracklet_id").agg(F.count(F.lit(1)).alias("k"), F.sum("tpa").alias("hits"))
    purity = per_track.join(merged, "track_id", "left").agg(
        F.avg(F.coalesce("best", F.lit(0)) / F.col("np")).alias("mean_predicted_tracklet_purity"), F.count_if(F.col("k") > 1).alias("merged_prediction_tracklets")
    )
    coverage = per_truth.join(split, "tracklet_id", "left").agg(
        F.avg(F.coalesce("hits", F.lit(0)) / F.col("nt")).alias("mean_truth_tracklet_frame_coverage"), F.count_if(F.col("k") > 1).alias("split_truth_tracklets")
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    switches = identity_switches(matches).agg(zero("switches").alias("identity_switches"), F.count_if(F.col("switches") > 0).alias("tracklets_with_id_switch"))
    broken = fragments(truth, matches).agg(
        F.count_if(F.col("segments") > 1).alias("fragmented_truth_tracklets"), F.coalesce(F.sum(F.greatest(F.col("segments") - 1, F.lit(0))), F.lit(0)).alias("extra_truth_fragments")
    )
    out = _one(counts, association, purity, coverage, switches, broken)
    tp, fp, fn = F.col("true_positives"), F.col("predicted_boxes") - F.col("true_positives"), F.col("truth_boxes") - F.col("true_positives")
    out = out.withColumns({"false_positives": fp, "false_negatives": fn, "precision": boxes.precision(tp, fp, fn), "recall": boxes.recall(tp, fp, fn)})
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = out.withColumns({
        "f1": boxes.f1(F.col("precision"), F.col("recall")), "det_a": F.when(tp + fp + fn > 0, tp / (tp + fp + fn)),
        "false_positive_tracklets": F.col("predicted_tracklets") - F.col("matched_predicted_tracklets"),
        "false_negative_tracklets": F.col("truth_tracklets") - F.col("matched_truth_tracklets"),
        "tracklet_precision": ratio("matched_predicted_tracklets", "predicted_tracklets"),
        "tracklet_recall": ratio("matched_truth_tracklets", "truth_tracklets"),
        "false_positives_per_scored_frame": F.when(F.col("scored_frames") > 0, fp / F.col("scored_frames")),
    })
    hota = F.when(F.col("det_a").isNotNull(), F.coalesce(F.sqrt(F.col("det_a") * F.col("ass_a")), F.lit(0.0)))
    return out.withColumn("hota", hota)


def robust_z(rows: DataFrame, value: str) -> DataFrame:
    """rows with z: distance from the median in robust scales (plain deviations where that is 0), within -5 and 5.

    Null for values that aren't finite, and everywhere with fewer than two values or without spread.
    """
    known = rows.withColumn("z", finite(F.col(value).cast("double")))
    stats = known.agg(F.median("z").alias("m"), F.stddev_pop("z").alias("s"), F.count("z").alias("n"))
    off = known.where("z is not null").join(stats).agg(F.median(F.abs(F.col("z") - F.col("m"))).alias("d"))
    scale = F.when(F.col("d") * 1.4826 > 1e-12, F.col("d") * 1.4826).when(F.col("s") > 1e-12, F.col("s"))
    z = F.when(F.col("n") >= 2, (F.col("z") - F.col("m")) / scale)
    return known.join(_one(stats, off)).withColumn("z", F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-5.0)), F.lit(5.0)))).drop("m", "s", "n", "d")


def stress_scores(features: DataFrame, names: list[str], parts: int = 4) -> DataFrame:
    """features with stress_score, the mean of the features' robust z-scores, and subset, Q1 to Q<parts> by rank; unscored without any.

    Frames are ranked by score, then number; the i-th of n is in part floor(i * parts / n).
    """
    out, zs = features, []
    for i, name in enumerate(names):
        out = robust_z(out, name).withColumnRenamed("z", f"z{i}")
        zs.append(F.col(f"z{i}"))
    known = F.array_compact(F.array(*zs))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("stress_score", F.when(F.size(known) > 0, total / F.size(known))).drop(*[f"z{i}" for i in range(len(names))])
    scored = out.where("stress_score is not null").select("frame_index", "stress_score")
    n = scored.count()
    ranked = ranks(scored, ["stress_score", "frame_index"]).select("frame_index", F.least(F.floor(F.col("rank") * parts / max(n, 1)), F.lit(parts - 1)).alias("q"))
    out = out.join(ranked, "frame_index", "left")
    return out.withColumn("subset", F.coalesce(F.concat(F.lit("Q"), (F.col("q") + 1).cast("string")), F.lit("unscored"))).drop("q")


def artifact_evidence(tracks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Each track's recurrence evidence: means and maxima of overlap and probability, and how often the larger reaches the threshold.

    The score is the mean of the larger of both, over detections that have either, times that share.
    """
    unit = lambda c: F.when(finite(F.col(c)).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)))
    o, p = unit("overlap"), unit("probability")
    best = F.greatest(o, p)
    out = tracks.groupBy("track_id").agg(
        F.count(best).alias("n_scored"), F.avg(o).alias("mean_overlap"), F.max(o).alias("max_overlap"), F.avg(p).alias("mean_probability"),
        F.max(p).alias("max_probability"), F.avg(best).alias("mean"), F.count_if(best >= threshold).alias("hits"),
    )
    hit = F.when(F.col("n_scored") > 0, F.col("hits") / F.col("n_scored")).otherwise(0.0)
    out = out.withColumn("hit_fraction", hit)
    return out.withColumn("artifact_score", F.coalesce(F.col("mean"), F.lit(0.0)) * F.col("hit_fraction")).drop("mean", "hits")


def _within(x: Column, low: float, high: float) -> Column:
    """1 within an interval, falling to 0 over its width outside."""
    off = F.greatest(F.lit(low) - x, x - F.lit(high), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - off / max(high - low, 1e-9))


def score_velocities(
    velocities: DataFrame, evidence: DataFrame | None = None, least: int = 5, low: float = 0.0, high: float = 1.1,
    max_lateral: float | None = None, max_artifact: float | None = None,
) -> DataFrame:
    """velocities (track_id, n_detections, v_y, v_x, ratio) with four gates, accepted and plausibility_score.

    evidence is what artifact_evidence gives; tracks without any count as unmarked. A limit of None
    lets all pass; one of 0 for lateral velocity passes exact zeros only.
    """
    if evidence is None:
        scored = velocities.withColumn("artifact_score", F.lit(0.0))
    else:
        scored = velocities.join(evidence, "track_id", "left").fillna(0.0, ["artifact_score"])
    x, art = F.abs("v_x"), F.col("artifact_score")
    gates = {
        "passes_length": F.col("n_detections") >= least, "passes_ratio": F.col("ratio").between(low, high),
        "passes_lateral": F.lit(True) if max_lateral is None else x <= max_lateral,
        "passes_artifact": F.lit(True) if max_artifact is None else art <= max_artifact,
    }
    lateral = F.lit(1.0) if max_lateral is None else (F.when(x == 0, 1.0).otherwise(0.0) if max_lateral == 0 else F.greatest(F.lit(0.0), 1 - x / max_lateral))
    score = F.least(F.lit(1.0), F.col("n_detections") / least) * _within(F.col("ratio"), low, high) * lateral * F.greatest(F.lit(0.0), 1 - art)
    accepted = gates["passes_length"] & gates["passes_ratio"] & gates["passes_lateral"] & gates["passes_artifact"]
    return scored.withColumns(gates | {"accepted": accepted, "plausibility_score": score})


def resamples(known: DataFrame, n: int, samples: int, seed: int = 0, block: int = 1) -> DataFrame:
    """sample and the columns of known, whose i numbers its n rows from 0: n draws with replacement for each sample; with a block length, runs that go round the end.

    Draws are a hash of seed, sample and block, so a sample doesn't depend on how many others there are. Draws, not the
    rows drawn, are shuffled, to the stretch of rows that they start in; they are too many to be broadcast.
    """
    blocks, width = -(-n // block), min(block, n, 1000)
    size = F.least(F.lit(block), F.lit(n) - F.col("b") * block)
    draws = known.sparkSession.range(samples * blocks).select(F.expr(f"id div {blocks}").alias("sample"), F.expr(f"id % {blocks}").alias("b"))
    draws = draws.select("sample", F.pmod(F.xxhash64(F.lit(seed), "sample", "b"), F.lit(n)).alias("start"), size.alias("size"))
    if width < block:
        draws = draws.select("sample", "start", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(width))).alias("o"))
        draws = draws.select("sample", F.pmod(F.col("start") + F.col("o"), F.lit(n)).alias("start"), F.least(F.lit(width), F.col("size") - F.col("o")).alias("size"))
    names = [c for c in known.columns if c != "i"]
    i, last = F.col("i"), (n - 1) // width
    place = F.explode(F.when(i < width, F.array(i, i + n)).otherwise(F.array(i)))
    rows = known.select(place.alias("p"), F.struct(*names).alias("row"))
    stretch = F.explode(F.array(F.expr(f"p div {width}"), F.expr(f"p div {width} - 1"))).alias("stretch")
    rows = rows.select(stretch, "p", "row").where(F.col("stretch").between(0, last))
    stretches = rows.groupBy("stretch").agg(F.array_sort(F.collect_list(F.struct("p", "row"))).alias("rows"))
    draws = draws.withColumn("stretch", F.expr(f"start div {width}")).hint("merge")
    own = F.slice("rows", (F.col("start") % width + 1).cast("int"), F.col("size").cast("int"))
    return draws.join(stretches.hint("merge"), "stretch").select("sample", F.explode(own).alias("x")).select("sample", "x.row.*")


def _bounds(name: str, level: float) -> list[Column]:
    x, alpha = finite(F.col(name).cast("double")), (1 - level) / 2
    return [F.median(x).alias(f"{name}_bootstrap_median"), F.percentile(x, F.lit(alpha)).alias(f"{name}_ci_low"), F.percentile(x, F.lit(1 - alpha)).alias(f"{name}_ci_high")]


def interval(estimates: DataFrame, name: str, level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """Median and equal-tailed bounds of the finite estimates."""
    return estimates.groupBy(*by).agg(*_bounds(name, level)) if by else estimates.agg(*_bounds(name, level))


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with i, their number from 0 in order."""
    return ranks(rows, order).withColumnRenamed("rank", "i")


def bootstrap(values: DataFrame, value: str, order: list, metrics: dict[str, Column], samples: int, seed: int = 0, block: int = 1, level: float = 0.95) -> DataFrame:
    """One row: the interval of each metric (an aggregate of the value column) over resamples of the finite values, in order."""
    known = numbered(values.where(finite(F.col(value).cast("double")).isNotNull()), order).select("i", value)
    n = known.count()
    if n:
        each = resamples(known, n, samples, seed, block).groupBy("sample").agg(*[c.alias(m) for m, c in metrics.items()])
    else:
        each = values.limit(0).select(*[F.lit(None).cast("double").alias(m) for m in metrics])
    return each.agg(*[c for m in metrics for c in _bounds(m, level)])


def bootstrap_outcomes(outcomes: DataFrame, samples: int, seed: int = 0, block: int = 1, level: float = 0.95) -> DataFrame:
    """One row: intervals of precision, recall and F1 over resamples of the frames' outcomes."""
    known = numbered(outcomes, ["frame_index"]).select("i", "tp", "fp", "fn")
    each = outcome_scores(resamples(known, max(known.count(), 1), samples, seed, block), ["sample"])
    return each.agg(*[c for m in ("precision", "recall", "f1") for c in _bounds(m, level)])
