"""Checks of a run's frames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detections_per_frame(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections of every frame, 0 where there are none."""
    counts = detections.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"))
    out = frames.select("frame_index").join(counts, "frame_index", "left")
    return out.select("frame_index", F.coalesce("n", F.lit(0)).cast("long").alias("n_detections"))


def missing_numbers(frames: DataFrame) -> DataFrame:
    """Numbers between the smallest and the largest frame that no frame has."""
    low, high = frames.agg(F.min("frame_index"), F.max("frame_index")).first()
    spark = frames.sparkSession
    every = spark.range(0) if low is None else spark.range(low, high + 1)
    return every.withColumnRenamed("id", "frame_index").join(frames.select("frame_index"), "frame_index", "left_anti")


def duplicate_contents(files: DataFrame, key: str, content: str) -> DataFrame:
    """SHA-256 of contents that stand more than once."""
    out = files.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")


def worst_frames(per_frame: DataFrame, phases: DataFrame, n: int = 10) -> DataFrame:
    """The n frames with most detections, and those with the largest corrections; ties to the smaller frame."""
    crowded = per_frame.select(F.lit("detections").alias("metric"), "frame_index", F.col("n_detections").cast("double").alias("value"))
    moved = phases.select(F.lit("correction").alias("metric"), "frame_index", F.abs("correction_px").alias("value"))
    return crowded.orderBy(F.desc("value"), "frame_index").limit(n).union(moved.orderBy(F.desc("value"), "frame_index").limit(n))


def drift(per_frame: DataFrame, phases: DataFrame) -> DataFrame:
    """Slopes over frames of detections, corrections and scores."""
    rows = per_frame.join(phases, "frame_index")
    return rows.agg(
        F.regr_slope("n_detections", "frame_index").alias("detections_slope"),
        F.regr_slope("correction_px", "frame_index").alias("correction_slope"),
        F.regr_slope("score", "frame_index").alias("score_slope"),
    )
