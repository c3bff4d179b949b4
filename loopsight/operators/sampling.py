"""Which frames to use, and score thresholds by false discovery rate."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopsight.operators.ordered import running


def sample_indices(spark: SparkSession, n: int, k: int) -> DataFrame:
    """k distinct indices (1 to n of them) spread evenly over 0 to n - 1, truncated; the last is n - 1. None without frames."""
    if n <= 0:
        return spark.range(0).withColumnRenamed("id", "frame_index")
    k = max(1, min(n, k))
    step = (n - 1) / (k - 1) if k > 1 else 0.0
    at = F.when(F.col("id") == k - 1, F.lit(n - 1 if k > 1 else 0).cast("long")).otherwise(F.floor(F.col("id") * F.lit(step)))
    return spark.range(k).select(at.alias("frame_index")).distinct()


def round_robin_plan(phases: DataFrame, period: float, buckets: int, n: int) -> DataFrame:
    """n frames, the cheapest of each phase bucket first, then the second cheapest of each, and so on."""
    bucket = F.least(F.floor(F.col("predicted_phase_px") / F.lit(period / buckets)), F.lit(buckets - 1))
    rows = phases.select("frame_index", bucket.alias("bucket"), (1 - F.col("score")).alias("cost"))
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy("cost", "frame_index"))
    # no bucket gives more than n frames: this bounds what is ordered as a whole
    return rows.withColumn("turn", turn.cast("long")).where(F.col("turn") <= n).orderBy("turn", "bucket").limit(n)


def frames_by_density(detections: DataFrame, threshold: float) -> DataFrame:
    """The share of each frame's detections above the threshold."""
    above = F.avg((F.col("peak_signal") > threshold).cast("double"))
    return detections.groupBy("frame_index").agg(above.alias("density"), F.count(F.lit(1)).alias("n"))


def empirical_p_values(scores: DataFrame, background: DataFrame) -> DataFrame:
    """For each distinct score: its rows n, and (1 + background scores at or above it) / (1 + all background scores).

    Scores are counted by value before anything is ordered.
    """
    own = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("b"))
    other = background.groupBy("score").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("b"))
    both = own.unionByName(other).groupBy("score").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    total = background.agg(F.count(F.lit(1)).alias("total"))
    out = running(both, [F.desc("score")], {"above": F.col("b")}).join(total).where("n > 0")
    return out.select("score", "n", ((F.col("above") + 1) / (F.col("total") + 1)).alias("p"))


def fdr_threshold(p_values: DataFrame, rate: float) -> DataFrame:
    """Benjamini and Hochberg's step-up: the largest p within rate * rank / all, and the smallest score at or below it."""
    total = p_values.agg(F.sum("n").alias("m"))
    by_p = p_values.groupBy("p").agg(F.sum("n").alias("n"), F.min("score").alias("score"))
    ranked = running(by_p, ["p"], {"rank": F.col("n")}).join(total)
    passing = ranked.where(F.col("p") <= F.lit(rate) * F.col("rank") / F.col("m"))
    return passing.agg(F.max("p").alias("cutoff"), F.min("score").alias("threshold"), F.sum("n").alias("discoveries"))
