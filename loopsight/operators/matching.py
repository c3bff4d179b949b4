"""Detections against truth: box joins, mutual best pairs, precision and recall, score curves."""

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopsight.functions import boxes, scores
from loopsight.operators.ordered import running


def iou_pairs(detections: DataFrame, truth: DataFrame, least: float = 0.25) -> DataFrame:
    """Pairs of a detection and a truth box of one frame whose IoU is at least `least`.

    Boxes are never broadcast: there are many of them for their files' size, which Spark goes by.
    """
    found = detections.join(truth.hint("merge"), "frame_index")
    found = found.withColumn("iou", boxes.iou(boxes.sides("bbox_"), boxes.sides("t_")))
    return found.where(F.col("iou") >= least)


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's best: highest IoU, ties to the smaller number. At most one for each box."""
    of_detection = Window.partitionBy("frame_index", "label").orderBy(F.desc("iou"), "truth_id")
    of_truth = Window.partitionBy("frame_index", "truth_id").orderBy(F.desc("iou"), "label")
    ranked = pairs.withColumn("a", F.row_number().over(of_detection)).withColumn("b", F.row_number().over(of_truth))
    return ranked.where("a = 1 and b = 1").drop("a", "b")


def precision_recall(detections: DataFrame, truth: DataFrame, least: float = 0.25) -> DataFrame:
    """Counts and scores by mutual best pairs, which SQL can say; evaluation.detection_metrics matches for the most pairs."""
    tp = mutual_best(iou_pairs(detections, truth, least)).agg(F.count(F.lit(1)).alias("tp"))
    nd = detections.agg(F.count(F.lit(1)).alias("nd"))
    nt = truth.agg(F.count(F.lit(1)).alias("nt"))
    counts = tp.join(nd).join(nt).selectExpr("tp", "nd - tp as fp", "nt - tp as fn")  # three single rows
    args = [F.col(c) for c in ("tp", "fp", "fn")]
    out = counts.withColumn("precision", boxes.precision(*args)).withColumn("recall", boxes.recall(*args))
    return out.withColumn("f1", boxes.f1(F.col("precision"), F.col("recall")))


def froc_curve(detections: DataFrame, truth: DataFrame, frames: int, step: float = 1.0) -> DataFrame:
    """At each threshold on a grid: true and false detections kept, recall, false ones a frame, recall's running maximum.

    Detections are matched once, over all scores, so a point differs from matching what it keeps (see froc_rematched).
    They are counted by grid cell before anything is ordered, so the window sees grid rows only.
    """
    hits = mutual_best(iou_pairs(detections, truth)).select("frame_index", "label", F.lit(1).alias("hit"))
    scored = detections.join(hits, ["frame_index", "label"], "left")
    cells = scored.groupBy(F.floor(F.col("peak_signal") / step).alias("cell")).agg(
        F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    total = truth.agg(F.count(F.lit(1)).alias("nt"))
    out = running(cells, [F.desc("cell")], {"tp": F.col("hits"), "fp": F.col("n") - F.col("hits")})
    out = out.join(total).withColumn("recall", F.col("tp") / F.col("nt"))
    out = out.withColumn("fp_per_frame", F.col("fp") / F.lit(frames))
    out = running(out, ["fp_per_frame", "recall", "cell"], tops={"envelope": F.col("recall")})
    return out.select((F.col("cell") * step).alias("threshold"), "tp", "fp", "recall", "fp_per_frame", "envelope")


def greedy_matches(pairs: list[tuple[float, int, int]]) -> int:
    """How many pairs (iou, detection, truth), sorted best first, are taken if each box is taken once."""
    found, sought = set(), set()
    for _, d, t in pairs:
        if d not in found and t not in sought:
            found.add(d)
            sought.add(t)
    return len(found)


def _iou(a: list, b: list) -> float:
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def score_steps(found: list[tuple], truth: list[list], least: float) -> list[tuple[float | None, int, int]]:
    """(score, more matches, more detections) at each distinct score of a frame, highest first; None is before all.

    found are (score or None, label, box). Detections without a finite score are always kept. All
    that are kept at a score are matched anew, best IoU first, so matches may also move.
    """
    rows = [(x if x is not None and math.isfinite(x) else None, label, box) for x, label, box in found]
    rows.sort(key=lambda r: (r[0] is not None, r[1]))
    pairs = [(_iou(r[2], t), i, j) for i, r in enumerate(rows) for j, t in enumerate(truth)]
    pairs = sorted((x for x in pairs if x[0] >= least), reverse=True)
    out, before = [], 0
    for score in [None, *sorted({r[0] for r in rows if r[0] is not None}, reverse=True)]:
        new = {i for i, r in enumerate(rows) if r[0] == score}
        now = before
        if any(i in new for _, i, _ in pairs):
            now = greedy_matches([x for x in pairs if rows[x[1]][0] is None or (score is not None and rows[x[1]][0] >= score)])
        out.append((score, now - before, len(new)))
        before = now
    return out


def froc_rematched(detections: DataFrame, truth: DataFrame, frames: int, least: float = 0.25) -> DataFrame:
    """A point without detections (threshold null), then one at each distinct score: what it keeps, matched anew.

    Within a frame matches change only at the frame's own scores, so each frame yields its steps
    and their sums are the whole curve. Columns are those of froc_curve; without truth boxes recall is null.
    """
    steps_type = pa.list_(pa.struct([("score", pa.float64()), ("tp", pa.int64()), ("n", pa.int64())]))

    @F.arrow_udf("array<struct<score: double, tp: long, n: long>>")
    def steps(found: pa.Array, sought: pa.Array) -> pa.Array:
        out = []
        for d, t in zip(found.to_pylist(), sought.to_pylist(), strict=True):
            boxed = [(x["score"], x["label"], x["box"]) for x in d]
            true = [x["box"] for x in sorted(t or [], key=lambda x: x["truth_id"])]
            out.append([dict(zip(("score", "tp", "n"), x, strict=True)) for x in score_steps(boxed, true, least)])
        return pa.array(out, type=steps_type)

    def box(prefix: str):
        return F.array(*[F.col(prefix + side).cast("double") for side in ("top", "left", "bottom", "right")]).alias("box")

    found = detections.groupBy("frame_index").agg(F.collect_list(F.struct(F.col("peak_signal").alias("score"), "label", box("bbox_"))).alias("found"))
    sought = truth.groupBy("frame_index").agg(F.collect_list(F.struct("truth_id", box("t_"))).alias("sought"))
    each = found.join(sought, "frame_index", "left").select(F.explode(steps(F.col("found"), F.col("sought"))).alias("s"))
    by_score = each.groupBy("s.score").agg(F.sum("s.tp").alias("tp"), F.sum("s.n").alias("n"))
    out = running(by_score, [F.desc_nulls_first("score")], {"all": F.col("tp"), "kept": F.col("n")}).select("score", F.col("all").alias("tp"), "kept")
    empty = detections.sparkSession.createDataFrame([(None, 0, 0)], "score double, tp long, kept long")
    out = out.where("score IS NOT NULL").unionByName(empty)
    out = out.join(truth.agg(F.count(F.lit(1)).alias("nt"))).withColumn("fp", F.col("kept") - F.col("tp"))
    out = out.withColumn("recall", F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")))
    out = out.withColumn("fp_per_frame", F.col("fp") / F.lit(frames))
    out = running(out, ["fp_per_frame", F.desc_nulls_first("score")], tops={"best": F.col("recall")})
    equal = F.max("best").over(Window.partitionBy("fp_per_frame"))
    return out.select(F.col("score").alias("threshold"), "tp", "fp", "recall", "fp_per_frame", equal.alias("envelope"))


def audit_boxes(detections: DataFrame, height: int, width: int, margin: int = 0, min_extent: int = 4, max_aspect: float = 4.0) -> DataFrame:
    """Edge flags and shape gates of each box; boxes without area are left out."""
    top, left, bottom, right = boxes.sides("bbox_")
    h, w = bottom - top, right - left
    out = detections.where((h > 0) & (w > 0)).select(
        "frame_index", "label", (top <= margin).alias("at_top"), (left <= margin).alias("at_left"),
        (bottom >= height - margin).alias("at_bottom"), (right >= width - margin).alias("at_right"),
        ((h >= min_extent) & (w >= min_extent) & (F.greatest(h / w, w / h) <= max_aspect)).alias("passes_shape"),
    )
    return out.withColumn("is_truncated", F.col("at_top") | F.col("at_left") | F.col("at_bottom") | F.col("at_right"))


def confidence(detections: DataFrame, threshold: float, height: int, width: int) -> DataFrame:
    """Logistic signal margin, weighted by area_px, artifact overlap and truncation; measures that detections lack are unknown."""
    top, left, bottom, right = boxes.sides("bbox_")
    cut = (top <= 0) | (left <= 0) | (bottom >= height) | (right >= width)
    peak, mean, area, overlap = (F.col(c) if c in detections.columns else F.lit(None).cast("double") for c in ("peak_signal", "mean_signal", "area_px", "overlap"))
    return detections.select("frame_index", "label", scores.trust_confidence(peak, mean, area, overlap, cut, threshold).alias("confidence"))
