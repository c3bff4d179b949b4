"""Detections confirmed by other detections: of other maps, other runs, other cameras, or of their own track."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopsight.functions import boxes, scores
from loopsight.functions.cyclic import finite
from loopsight.operators.assignment import optimal_pairs

_BOX = ("bbox_top", "bbox_left", "bbox_bottom", "bbox_right")


def _renamed(rows: DataFrame, prefix: str, keep: tuple = ("frame_index",)) -> DataFrame:
    return rows.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in rows.columns])


def cross_map_matches(
    primary: DataFrame, confirming: DataFrame, max_distance: float = 4.0, min_iou: float = 0.0, min_ratio: float = 0.25, same_sign: bool = True,
) -> DataFrame:
    """frame_index, label, map_index and the match of each primary detection with each confirming map that has detections in its frame.

    Rows hold label, y, x, a box, peak_signal and sign (1, -1 or null); confirming rows map_index too.
    A pair is accepted by its distance, IoU, peak ratio and sign; accepted pairs of a map are matched
    one to one: the most, then by IoU, peak ratio and distance. A detection without such a match
    shows its best candidate (acceptable first, then by IoU, ratio and distance), not accepted.
    """
    met = _renamed(primary, "p_").join(_renamed(confirming, "c_", ("frame_index", "map_index")), "frame_index")
    distance = F.hypot(F.col("p_y") - F.col("c_y"), F.col("p_x") - F.col("c_x"))
    met = met.select(
        "frame_index", "map_index", F.col("p_label").alias("label"), F.col("c_label").alias("matched_label"), distance.alias("distance"),
        boxes.iou(boxes.sides("p_bbox_"), boxes.sides("c_bbox_")).alias("iou"), scores.peak_ratio(F.col("p_peak_signal"), F.col("c_peak_signal")).alias("ratio"),
        (F.col("p_sign") == F.col("c_sign")).alias("sign_consistent"),
    )
    fits = (F.col("distance") <= max_distance) & (F.col("iou") >= min_iou) & F.coalesce(F.col("ratio") >= min_ratio, F.lit(False))
    met = met.withColumn("fits", fits & F.coalesce("sign_consistent", F.lit(False)) if same_sign else fits)
    gains = [F.col("iou"), F.coalesce("ratio", F.lit(0.0)), -F.col("distance")]
    chosen = optimal_pairs(met.where("fits"), "label", "matched_label", gains, ["frame_index", "map_index"])
    rank = Window.partitionBy("frame_index", "map_index", "label").orderBy(
        F.desc("fits"), F.desc("iou"), F.desc(F.coalesce("ratio", F.lit(0.0))), "distance", "matched_label"
    )
    best = met.withColumn("n", F.row_number().over(rank)).where("n = 1").drop("n")
    rest = best.join(chosen, ["frame_index", "map_index", "label"], "left_anti").withColumn("fits", F.lit(False))
    return chosen.unionByName(rest).withColumnRenamed("fits", "accepted")


def cross_map_agreement(primary: DataFrame, confirming: DataFrame, least: int = 2, **gates) -> DataFrame:
    """primary with confirming_maps, the maps that accept each detection, and accepted, whether that's `least` or more."""
    met = cross_map_matches(primary, confirming, **gates).where("accepted")
    counts = met.groupBy("frame_index", "label").agg(F.count(F.lit(1)).alias("confirming_maps"))
    out = primary.join(counts, ["frame_index", "label"], "left").fillna(0, ["confirming_maps"])
    return out.withColumn("accepted", F.col("confirming_maps") >= least)


def agreed(scored: DataFrame, filtering: bool = True) -> DataFrame:
    return scored.where("accepted") if filtering else scored


def sample_folds(samples: DataFrame, least: int = 1) -> DataFrame:
    """samples with the fold (0 or 1) of every second one, in order; none where a fold would have fewer than `least`."""
    n = samples.count()
    if n // 2 < least:
        return samples.limit(0).withColumn("fold", F.lit(0).cast("long"))
    return samples.withColumn("fold", (F.row_number().over(Window.orderBy("frame_index")) - 1).cast("long") % 2)  # samples are few


def raw_sign(detections: DataFrame, residuals: DataFrame) -> DataFrame:
    """detections with sign: that of the residual at the rounded centroid, else of its mean over the box; null where undefined.

    residuals are (frame_index, y, x, raw), valid pixels only. Centroids are rounded half to even.
    """
    seen = residuals.select("frame_index", F.col("y").alias("py"), F.col("x").alias("px"), finite(F.col("raw").cast("double")).alias("raw"))
    spot = detections.select("frame_index", "label", F.rint("y").cast("long").alias("py"), F.rint("x").cast("long").alias("px"))
    at = spot.join(seen, ["frame_index", "py", "px"]).select("frame_index", "label", F.signum("raw").alias("s")).where("s <> 0")
    # boxes are cut into their rows, so a pixel row meets the boxes that it runs through
    rows = detections.where("bbox_bottom > greatest(bbox_top, 0)").select(
        "frame_index", "label", F.explode(F.sequence(F.greatest(F.col("bbox_top"), F.lit(0)), F.col("bbox_bottom") - 1)).alias("py"), "bbox_left", "bbox_right"
    )
    inside = rows.join(seen, ["frame_index", "py"]).where("px >= bbox_left and px < bbox_right")
    mean = inside.groupBy("frame_index", "label").agg(F.signum(F.avg("raw")).alias("m"))
    out = detections.join(at, ["frame_index", "label"], "left").join(mean, ["frame_index", "label"], "left")
    return out.withColumn("sign", F.coalesce("s", F.when(F.col("m") != 0, F.col("m"))).cast("int")).drop("s", "m")


def _grown(prefix: str, margin: float) -> tuple:
    top, left, bottom, right = boxes.sides(prefix)
    return top - margin, left - margin, bottom + margin, right + margin


def confirmation_pairs(candidates: DataFrame, confirmers: DataFrame, margin: float = 0.0, other_margin: float = 0.0) -> DataFrame:
    """frame_index, label, confirmation_label, iou and distance of all pairs of a frame; boxes are grown by their margins."""
    met = _renamed(candidates.select("frame_index", "label", "y", "x", *_BOX), "a_").join(_renamed(confirmers.select("frame_index", "label", "y", "x", *_BOX), "b_"), "frame_index")
    return met.select(
        "frame_index", F.col("a_label").alias("label"), F.col("b_label").alias("confirmation_label"),
        boxes.iou(_grown("a_bbox_", margin), _grown("b_bbox_", other_margin)).alias("iou"),
        F.hypot(F.col("a_y") - F.col("b_y"), F.col("a_x") - F.col("b_x")).alias("distance"),
    )


def best_confirmation(pairs: DataFrame, min_iou: float, max_distance: float, max_match: float | None = None) -> DataFrame:
    """Each candidate's pair of highest IoU, then smallest distance, if it's near enough by either; ties to the smaller label."""
    first = Window.partitionBy("frame_index", "label").orderBy(F.desc("iou"), "distance", "confirmation_label")
    best = pairs.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    if max_match is not None:
        best = best.where(F.col("distance") <= max_match)
    return best.where((F.col("iou") >= min_iou) | (F.col("distance") <= max_distance))


def one_to_one(pairs: DataFrame, min_iou: float, max_distance: float, max_match: float | None = None) -> DataFrame:
    """Pairs taken best first, no candidate and no confirmer twice, within each frame.

    Pairs without overlap score by distance, below all others; ties go to the larger candidate, then confirmer.
    """
    near = pairs.where((F.col("iou") >= min_iou) | (F.col("distance") <= max_distance))
    if max_match is not None:
        near = near.where(F.col("distance") <= max_match)
    by_distance = F.greatest(F.lit(0.0), 1 - F.col("distance") / max(max_distance, 1.0)) * 1e-3
    score = F.when(F.col("iou") > 0, F.col("iou")).otherwise(by_distance)
    order = F.array_sort(F.collect_list(F.struct(score.alias("s"), (-F.col("distance")).alias("d"), "label", "confirmation_label")))
    frames = near.groupBy("frame_index").agg(F.reverse(order).alias("pairs"))
    kind = pa.list_(pa.struct([("label", pa.int64()), ("confirmation_label", pa.int64())]))

    @F.arrow_udf("array<struct<label: long, confirmation_label: long>>")
    def taken(column: pa.Array) -> pa.Array:
        out = []
        for row in column.to_pylist():
            left, right, found = set(), set(), []
            for p in row:
                a, b = p["label"], p["confirmation_label"]
                if a not in left and b not in right:
                    left.add(a)
                    right.add(b)
                    found.append({"label": a, "confirmation_label": b})
            out.append(found)
        return pa.array(out, type=kind)

    chosen = frames.select("frame_index", F.inline(taken("pairs")))
    return pairs.join(chosen, ["frame_index", "label", "confirmation_label"], "left_semi")


def duplicate_order(rows: DataFrame) -> Column:
    """What is kept of duplicates comes first: directly confirmed, then by signal, area, IoU and distance of its confirmation."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.struct(
        F.when(F.coalesce("rescued", F.lit(False)), 0.0).otherwise(1.0).alias("direct"), zero("peak_signal").alias("peak"),
        zero("area_px").alias("area"), zero("confirmation_iou").alias("iou"),
        (-F.coalesce(F.col("confirmation_distance").cast("double"), F.lit(float("inf")))).alias("near"),
    )


def without_duplicates(rows: DataFrame, iou: float = 0.0, containment: float = 0.0, distance: float = 0.0, margin: float = 0.0) -> DataFrame:
    """rows with kept_label: null for those that stay, else the label of the row that each duplicates.

    Rows of a frame are taken in duplicate_order (ties by label); one is a duplicate of the first row
    kept that is near enough by distance, IoU or containment. A limit of 0 turns its test off. A
    frame's rows are one array in one task.
    """
    kind = pa.list_(pa.struct([("label", pa.int64()), ("kept_label", pa.int64())]))
    spot = F.struct(duplicate_order(rows).alias("order"), (-F.col("label")).alias("neg"), "label", F.array("y", "x").alias("at"), F.array(*[F.col(c).cast("double") for c in _BOX]).alias("box"))
    frames = rows.groupBy("frame_index").agg(F.reverse(F.array_sort(F.collect_list(spot))).alias("rows"))

    def same(a: dict, b: dict) -> bool:
        if distance > 0 and ((a["at"][0] - b["at"][0]) ** 2 + (a["at"][1] - b["at"][1]) ** 2) ** 0.5 <= distance:
            return True
        one, other = ([r["box"][0] - margin, r["box"][1] - margin, r["box"][2] + margin, r["box"][3] + margin] for r in (a, b))
        both = max(0.0, min(one[2], other[2]) - max(one[0], other[0])) * max(0.0, min(one[3], other[3]) - max(one[1], other[1]))
        sizes = [max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (one, other)]
        union, least = sum(sizes) - both, min(sizes)
        return (iou > 0 and union > 0 and both / union >= iou) or (containment > 0 and least > 0 and both / least >= containment)

    @F.arrow_udf("array<struct<label: long, kept_label: long>>")
    def judged(column: pa.Array) -> pa.Array:
        out = []
        for row in column.to_pylist():
            kept, found = [], []
            for r in row:
                first = next((k for k in kept if same(r, k)), None)
                if first is None:
                    kept.append(r)
                found.append({"label": r["label"], "kept_label": first["label"] if first else None})
            out.append(found)
        return pa.array(out, type=kind)

    return rows.join(frames.select("frame_index", F.inline(judged("rows"))), ["frame_index", "label"])


def track_confirmations(rows: DataFrame) -> DataFrame:
    """Each track's rows, those directly confirmed (with a confirmation and not merely rescued), and their share."""
    direct = F.col("confirmation_label").isNotNull() & ~F.coalesce("rescued", F.lit(False))
    out = rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_detections"), F.count_if(direct).alias("direct_confirmed_detections"))
    return out.withColumn("direct_confirmed_fraction", F.col("direct_confirmed_detections") / F.col("n_detections"))


def rescued(tracks: DataFrame, confirmed: DataFrame, min_detections: int, min_confirmed: int, min_fraction: float, max_frames: float | None = None) -> DataFrame:
    """(track_id, frame_index, label) of tracks with enough confirmed members; with max_frames, only members so near to one in frames."""
    known = tracks.select("track_id", "frame_index", "label").distinct()
    marked = known.join(confirmed.select("frame_index", "label").distinct().withColumn("yes", F.lit(1)), ["frame_index", "label"], "left")
    sums = marked.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.count("yes").alias("c"))
    good = sums.where((F.col("n") >= min_detections) & (F.col("c") >= min_confirmed) & (F.col("c") / F.col("n") >= min_fraction)).select("track_id")
    members = marked.join(good, "track_id")
    if max_frames is not None:
        # the nearest confirmed member before and after, in one pass over each track
        up = Window.partitionBy("track_id").orderBy("frame_index").rangeBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy("track_id").orderBy("frame_index").rangeBetween(0, Window.unboundedFollowing)
        at = F.when(F.col("yes").isNotNull(), F.col("frame_index"))
        gap = F.least(F.col("frame_index") - F.max(at).over(up), F.min(at).over(down) - F.col("frame_index"))
        members = members.withColumn("gap", gap).where(F.col("gap") <= max_frames)
    return members.select("track_id", "frame_index", "label")


def stitched(rows: DataFrame, max_time: float, max_phase: float) -> DataFrame:
    """rows with event: rows of different cameras near in time and phase are one event, named by its first row's number.

    rows hold number (their order), camera, time_s and phase, either of which may be null and then
    fits all. In order, each row not taken yet takes one row of each other camera that fits it.
    Times further apart than max_time never meet, so the rows are cut where no row has a time for
    longer than that, and pieces are stitched apart; with a null time all rows are one piece.
    """
    w = Window.orderBy("cell")  # over occupied time cells only
    cell = F.floor(finite(F.col("time_s")) / max(max_time, 1e-9))
    some = rows.withColumn("cell", cell)
    if not some.where("cell is null").isEmpty():
        pieced = some.withColumn("piece", F.lit(0).cast("long"))
    else:
        cells = some.select("cell").distinct().withColumn("new", (F.col("cell") - F.lag("cell").over(w) > 1).cast("long"))
        cells = cells.select("cell", F.sum(F.coalesce("new", F.lit(0))).over(w).alias("piece"))
        pieced = some.join(cells, "cell")
    grouped = pieced.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("number", "camera", finite(F.col("time_s")).alias("t"), finite(F.col("phase")).alias("p")))).alias("rows"))
    kind = pa.list_(pa.struct([("number", pa.int64()), ("event", pa.int64())]))

    @F.arrow_udf("array<struct<number: long, event: long>>")
    def events(column: pa.Array) -> pa.Array:
        fits = lambda a, b, most: a is None or b is None or abs(a - b) <= most
        out = []
        for row in column.to_pylist():
            event: dict = {}
            for r in row:
                if r["number"] in event:
                    continue
                event[r["number"]], cameras = r["number"], {r["camera"]}
                for o in row:
                    if o["number"] not in event and o["camera"] not in cameras and fits(r["t"], o["t"], max_time) and fits(r["p"], o["p"], max_phase):
                        event[o["number"]] = r["number"]
                        cameras.add(o["camera"])
            out.append([{"number": n, "event": e} for n, e in event.items()])
        return pa.array(out, type=kind)

    return rows.join(grouped.select(F.inline(events("rows"))), "number")


def stitched_events(rows: DataFrame, max_time: float, max_phase: float) -> DataFrame:
    """Events of stitched rows: cameras, mean time and mean phase of what is known."""
    return stitched(rows, max_time, max_phase).groupBy("event").agg(
        F.count(F.lit(1)).alias("cameras"), F.avg(finite(F.col("time_s"))).alias("mean_time_s"), F.avg(finite(F.col("phase"))).alias("mean_phase")
    )


def velocities_in(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Velocity rows whose middle frame (half to even), else start, else end is among the frames."""
    middle = F.coalesce(F.rint((F.col("frame_start") + F.col("frame_end")) / 2.0), F.col("frame_start").cast("double"), F.col("frame_end").cast("double"))
    keyed = rows.withColumn("middle", middle.cast("long"))
    return keyed.join(frames.select(F.col("frame_index").alias("middle")).distinct(), "middle", "left_semi").drop("middle")


def find_revisits(points: DataFrame, phases: DataFrame, phase: str, frame_height: int, patch: int, height: float) -> DataFrame:
    """points (number, frame_index, belt_y) with the frame of the revolution before and after that shows each best.

    Of the other frames of a revolution that show belt_y with a patch of that many rows whole around it
    (its upper edge rounded half to even), the one where it lies nearest to the middle of the frame,
    then the nearest in frames, then the first: revisit_before, revisit_after.
    """
    frames = phases.select(F.col("frame_index").alias("f"), F.col(phase).alias("p"), F.col("revolution").alias("r"))
    own = phases.select("frame_index", "revolution")
    met = points.join(own, "frame_index")
    out = points
    for name, step in (("revisit_before", -1), ("revisit_after", 1)):
        pairs = met.join(frames, F.col("r") == F.col("revolution") + step)
        pairs = pairs.withColumn("at", F.pmod(F.col("belt_y") - F.col("p"), F.lit(float(height)))).withColumn("top", F.rint(F.col("at") - 0.5 * patch))
        pairs = pairs.where((F.col("at") < frame_height) & (F.col("top") >= 0) & (F.col("top") + patch <= frame_height) & (F.col("f") != F.col("frame_index")))
        order = F.struct(F.abs(F.col("at") - frame_height / 2).alias("off"), F.abs(F.col("f") - F.col("frame_index")).alias("gap"), "f")
        out = out.join(pairs.groupBy("number").agg(F.min(order)["f"].alias(name)), "number", "left")
    return out
