"""Frames that arrive while the engine runs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILES = "path string, modificationTime timestamp, length long, content binary"


def new_frames(spark: SparkSession, folder: str, pattern: str = "*.png", most: int | None = None) -> DataFrame:
    """A stream of files not seen before, with the last number of their name; the checkpoint remembers what was seen."""
    source = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern)
    if most:
        source = source.option("maxFilesPerTrigger", most)
    return source.load(folder).select(
        "path", F.try_element_at(F.regexp_extract_all(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1), F.lit(r"(\d+)"), 1), F.lit(-1)).cast("long").alias("frame_index"),
        F.sha2("content", 256).alias("sha256"), "length",
    )


def blended(current: DataFrame, observed: DataFrame, rate: float) -> DataFrame:
    """The map (belt_row, x, v) moved towards what was observed, by `rate` where that is finite; new cells are taken as they are."""
    seen = observed.where(~F.isnan("v") & (F.abs("v") < float("inf"))).select("belt_row", "x", F.col("v").alias("o"))
    moved = F.when(F.col("o").isNull(), F.col("v")).when(F.col("v").isNull(), F.col("o"))
    out = current.join(seen, ["belt_row", "x"], "full")
    return out.select("belt_row", "x", moved.otherwise(F.col("v") * (1 - rate) + F.col("o") * rate).alias("v"))
