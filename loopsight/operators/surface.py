"""The surface map, phases and what recurs on the surface."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.functions import cyclic
from loopsight.operators.ordered import quantiles


def splat_linear(samples: DataFrame, phase, height: int) -> DataFrame:
    """Weighted mean and support of each cell: a value falls on two neighbouring rows by its fraction."""
    at = F.col("belt_row") + phase
    low = F.floor(at)
    part = at - low
    rows = F.array(F.struct(low.alias("r"), (1 - part).alias("w")), F.struct((low + 1).alias("r"), part.alias("w")))
    out = samples.select("x", "v", F.inline(rows)).where("w > 0")
    out = out.groupBy(F.pmod("r", F.lit(height)).alias("belt_row"), "x")
    return out.agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"), F.sum("w").alias("support"))


def static_noise(samples: DataFrame, least: float = 1e-6) -> DataFrame:
    """Median of each column and 1.4826 times the median distance from it."""
    middle = samples.groupBy("x").agg(F.median("v").alias("background"))
    off = samples.join(middle, "x").select("x", "background", F.abs(F.col("v") - F.col("background")).alias("d"))
    return off.groupBy("x", "background").agg(F.greatest(F.median("d") * 1.4826, F.lit(least)).alias("noise"))


def row_exposure(phases: DataFrame, height: int) -> DataFrame:
    """Fractional exposure of each belt row by the first row of every frame."""
    low = F.floor("predicted_phase_px")
    part = F.col("predicted_phase_px") - low
    rows = F.array(F.struct(low.alias("r"), (1 - part).alias("w")), F.struct((low + 1).alias("r"), part.alias("w")))
    out = phases.select(F.inline(rows)).where("w > 0").groupBy(F.pmod("r", F.lit(height)).alias("belt_row"))
    return out.agg(F.sum("w").alias("exposure"))


def uncertainty(exposure: DataFrame, scale: float = 1.0, least: float = 1.0) -> DataFrame:
    n = F.col("exposure")
    value = F.when(n <= 0, F.lit(scale)).otherwise(F.lit(scale) / F.sqrt(F.greatest(n, F.lit(least))))
    return exposure.select("belt_row", value.alias("uncertainty"))


def phase_errors(phases: DataFrame, period: float) -> DataFrame:
    true = cyclic.wrap(F.col("predicted_phase_px") + F.col("correction_px"), period)
    error = cyclic.cyclic_difference(F.col("predicted_phase_px"), true, period)
    return phases.select("frame_index", true.alias("true_phase_px"), error.alias("error_px"))


def error_summary(errors: DataFrame) -> DataFrame:
    """One row: number, bias, absolute errors' mean, median, 95th percentile and largest, and root mean square."""
    e, a = F.col("error_px"), F.abs("error_px")
    middle, high = (F.lit(x).cast("double") for x in quantiles(errors, a, [0.5, 0.95]))
    out = errors.agg(F.count(e).alias("n"), F.avg(e).alias("bias"), F.avg(a).alias("mae"), F.max(a).alias("max_abs"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return out.withColumns({"median_abs": middle, "p95_abs": high})


def artifact_counts(detections: DataFrame, phases: DataFrame, period: int, cell: int = 20, least: int = 2) -> DataFrame:
    """Cells of the surface that detections hit in at least `least` different revolutions."""
    y = (F.col("bbox_top") + F.col("bbox_bottom") - 1) * 0.5
    hits = detections.join(phases.select("frame_index", "predicted_phase_px", "revolution"), "frame_index").select(
        F.floor(cyclic.artifact_row(y, F.col("predicted_phase_px"), period) / cell).alias("row_cell"),
        F.floor(F.col("bbox_left") / cell).alias("x_cell"), "revolution",
    )
    out = hits.groupBy("row_cell", "x_cell").agg(
        F.countDistinct("revolution").alias("revolutions"), F.count(F.lit(1)).alias("hits")
    )
    return out.where(F.col("revolutions") >= least)


def split_summary(phases: DataFrame) -> DataFrame:
    """Counts and mean scores of even and odd revolutions, and of each revolution; no grand total."""
    rows = phases.withColumn("split", F.when(F.col("revolution") % 2 == 0, "train").otherwise("eval"))
    out = rows.groupingSets([["split"], ["split", "revolution"]], "split", "revolution")
    return out.agg(F.count(F.lit(1)).alias("frames"), F.avg("score").alias("mean_score"))
