"""Track statistics and velocities."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.kernels import slopes
from loopsight.operators.ordered import quantiles


def describe(rows: DataFrame, value: str) -> DataFrame:
    """count, mean, median, min, max and quartiles, with linear interpolation; quantiles are exact and found in ranges."""
    low, middle, high = (F.lit(x).cast("double") for x in quantiles(rows, F.col(value), [0.25, 0.5, 0.75]))
    out = rows.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select("count", "mean", middle.alias("median"), "min", "max", low.alias("q25"), high.alias("q75"))


def track_extents(tracks: DataFrame) -> DataFrame:
    """A row for each track: points, frames spanned, median place."""
    return tracks.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_detections"), F.min("frame_index").alias("frame_start"),
        F.max("frame_index").alias("frame_end"), F.median("y").alias("median_y"), F.median("x").alias("median_x"),
    )


def least_squares(tracks: DataFrame, belt_velocity: float) -> DataFrame:
    """Least-squares velocity of each track and its ratio to the belt's; null with fewer than two frames."""
    out = tracks.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_detections"), F.regr_slope("y", "frame_index").alias("v_y"),
        F.regr_slope("x", "frame_index").alias("v_x"),
    )
    return out.withColumn("speed", F.hypot("v_y", "v_x")).withColumn("ratio", F.col("v_y") / F.lit(belt_velocity))


def gates(velocities: DataFrame, least: int = 5, low: float = 0.0, high: float = 1.1) -> DataFrame:
    long, low_ok, high_ok = F.col("n_detections") >= least, F.col("ratio") >= low, F.col("ratio") <= high
    out = velocities.select("track_id", long.alias("passes_length"), low_ok.alias("passes_low"), high_ok.alias("passes_high"))
    return out.withColumn("accepted", F.col("passes_length") & F.col("passes_low") & F.col("passes_high"))


def _by_track(tracks: DataFrame) -> DataFrame:
    """track_id and its points as arrays t and y, in order; a track's points are one array in one task."""
    points = F.array_sort(F.collect_list(F.struct(F.col("frame_index").cast("double").alias("t"), F.col("y").cast("double").alias("y"))))
    rows = tracks.where("frame_index is not null and y is not null").groupBy("track_id").agg(points.alias("p"))
    return rows.select("track_id", F.col("p.t").alias("t"), F.col("p.y").alias("y"))


def _rows(t: pa.Array, y: pa.Array):
    for a, b in zip(t, y, strict=True):
        yield a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)


def theil_sen(tracks: DataFrame) -> DataFrame:
    """track_id, v_y, n_pairs: the median slope of all pairs of points at different frames; tracks without such a pair are left out."""
    kind = pa.struct([("v_y", pa.float64()), ("n_pairs", pa.int64())])

    @F.arrow_udf("v_y double, n_pairs long")
    def of(t: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("v_y", "n_pairs"), slopes.median_slope(a, b), strict=True)) for a, b in _rows(t, y)], type=kind)

    return _by_track(tracks).select("track_id", of("t", "y").alias("s")).select("track_id", "s.*").where("n_pairs > 0")


def repeated_median(tracks: DataFrame) -> DataFrame:
    """track_id, v_y: the median over points of the median slope through each; tracks without two frames are left out."""

    @F.arrow_udf("double")
    def of(t: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([slopes.repeated_median(a, b) for a, b in _rows(t, y)], type=pa.float64())

    return _by_track(tracks).select("track_id", of("t", "y").alias("v_y")).where("v_y is not null")
