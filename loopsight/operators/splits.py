"""Frames by revolution: training and evaluation parts, labelled and scored sets, sampling plans."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_indices(text: Column) -> Column:
    """Sorted distinct numbers of a list such as 1,3-5; an error for a falling or negative range."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")

    def numbers(p: Column) -> Column:
        a, b = (F.trim(F.element_at(F.split(p, "-"), i)).cast("long") for i in (1, -1))
        return F.when(b < a, F.raise_error(F.concat(F.lit("ranges must be increasing: "), p))).otherwise(F.sequence(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def revolution_split(frames: DataFrame, every: int = 3, offset: int = 0, explicit: list[int] = ()) -> DataFrame:
    """frames (frame_index, revolution, ...) with split: eval for the revolutions given, else for each every-th observed one, else train."""
    if explicit:
        held = F.col("revolution").isin(list(explicit))
        return frames.withColumn("split", F.when(held, "eval").otherwise("train"))
    seen = frames.select("revolution").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("revolution")) - 1)  # a row a revolution
    held = F.col("ordinal") % every == offset % every
    return frames.join(seen, "revolution").withColumn("split", F.when(held, "eval").otherwise("train")).drop("ordinal")


def frame_rows(split: DataFrame, selected: DataFrame) -> DataFrame:
    """frame_index, revolution, split and whether a training frame was selected for the map."""
    chosen = selected.select("frame_index").distinct().withColumn("yes", F.lit(True))
    return split.join(chosen, "frame_index", "left").select("frame_index", "revolution", "split", (F.coalesce("yes", F.lit(False)) & (F.col("split") == "train")).alias("selected"))


def revolution_rows(split: DataFrame, selected: DataFrame) -> DataFrame:
    return frame_rows(split, selected).groupBy("revolution", "split").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("selected").alias("n_selected"))


def split_rates(split: DataFrame, items: DataFrame, measures: list[Column]) -> DataFrame:
    """split, revolution, revolutions, frames, n, per_frame and measures: a row for each part and one for each revolution, none for all.

    items are rows with frame_index; measures are aggregates over them.
    """
    joined = split.select("frame_index", "revolution", "split").join(items, "frame_index", "left")
    sets = joined.withColumn("hit", F.col("item").isNotNull()).groupingSets([["split"], ["split", "revolution"]], "split", "revolution")
    out = sets.agg(
        F.grouping("revolution").alias("whole"), F.countDistinct("frame_index").alias("frames"), F.count_if("hit").alias("n"), *measures
    )
    return out.withColumn("per_frame", F.col("n") / F.col("frames"))


def scored_frames(scored: DataFrame, labelled: DataFrame) -> DataFrame:
    """Frames that are scored or hold a label."""
    return scored.select("frame_index").union(labelled.select("frame_index")).distinct()


def labelled_frames(labelled: DataFrame) -> DataFrame:
    return labelled.select("frame_index").distinct()


def empty_frames(scored: DataFrame, labelled: DataFrame) -> DataFrame:
    """Scored frames without a label."""
    return scored.select("frame_index").distinct().join(labelled, "frame_index", "left_anti")


def in_frames(rows: DataFrame, frames: DataFrame) -> DataFrame:
    return rows.join(frames.select("frame_index").distinct(), "frame_index", "left_semi")


def adaptive_frames(phases: DataFrame, phase: str, height: int, count: int, crop: int = 1, bins: int | None = None, quality: str | None = None) -> list[tuple[int, int]]:
    """(frame, gain) of up to count frames that cover the surface: each next one shows most bins not yet shown, then is best, then first.

    Of all frames of a bin only the best `count` can ever be chosen, and only those reach the driver:
    bins times count rows at most.
    """
    bins = bins or min(height, max(count * 2, 8))
    crop = min(crop, height)
    q = F.coalesce(F.col(quality).cast("double"), F.lit(0.0)) if quality else F.lit(1.0)
    q = F.when(F.isnan(q) | (F.abs(q) == float("inf")), 0.0).otherwise(q)
    at = F.least(F.floor(F.pmod(F.col(phase), F.lit(float(height))) / height * bins), F.lit(bins - 1))
    rows = phases.select("frame_index", at.alias("bin"), q.alias("q"))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("q"), "frame_index"))
    few: dict[int, list] = {}
    for r in rows.withColumn("r", rank).where(F.col("r") <= count).orderBy("bin", "r").collect():
        few.setdefault(r["bin"], []).append((r["q"], r["frame_index"]))
    span = max(1, -(-crop * bins // height))
    occupied, out = [0] * bins, []
    while few and len(out) < count:
        best = None
        for b, rest in few.items():
            gain = sum(occupied[(b + i) % bins] == 0 for i in range(span))
            key = (gain + 0.001 * rest[0][0], gain, rest[0][0], -rest[0][1], b)
            if best is None or key > best:
                best = key
        b = best[4]
        out.append((few[b].pop(0)[1], best[1]))
        if not few[b]:
            del few[b]
        for i in range(span):
            occupied[(b + i) % bins] += 1
    return out


def frame_plan(frames: DataFrame, counts: DataFrame, phases: DataFrame, phase: str, height: float, n: int) -> DataFrame:
    """frame_index, bucket, cost, n_detections: the cheapest frame of each phase bucket, then the second of each, and so on, n in all.

    A frame costs its detections plus ten times what its registration score lacks to 1; one without a
    phase has its number as phase.
    """
    buckets = max(1, min(n, 64))
    rows = frames.select("frame_index").distinct().join(counts.select("frame_index", "n_detections"), "frame_index", "left")
    rows = rows.join(phases.select("frame_index", F.col(phase).alias("p"), "score"), "frame_index", "left")
    p = F.coalesce("p", F.col("frame_index").cast("double"))
    bucket = F.floor(F.pmod(p, F.lit(float(height))) / height * buckets)
    cost = F.coalesce("n_detections", F.lit(0)) + 10 * F.greatest(F.lit(0.0), 1 - F.coalesce("score", F.lit(1.0)))
    rows = rows.select("frame_index", bucket.alias("bucket"), cost.alias("cost"), F.coalesce("n_detections", F.lit(0)).alias("n_detections"))
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy("cost", "frame_index"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", "bucket").limit(n)
