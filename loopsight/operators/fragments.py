"""Runs of frames within a track."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def track_fragments(tracks: DataFrame, max_gap: int = 1) -> DataFrame:
    """Runs of a track whose frames are no more than max_gap apart: first and last frame, points."""
    w = Window.partitionBy("track_id").orderBy("frame_index")
    gap = F.col("frame_index") - F.lag("frame_index").over(w)
    rows = tracks.select("track_id", "frame_index", F.when(gap <= max_gap, 0).otherwise(1).alias("new"))
    rows = rows.withColumn("fragment", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("track_id", "fragment").agg(
        F.min("frame_index").alias("frame_start"), F.max("frame_index").alias("frame_end"), F.count(F.lit(1)).alias("n")
    )
