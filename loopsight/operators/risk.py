"""How well the surface map is supported, rendered views of it, and detections judged by it.

Maps are rows (belt_row, x, ...), one for each cell of a rectangle of height rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopsight.functions.cyclic import finite
from loopsight.functions.values import clipped


def risk_maps(cells: DataFrame, support: str = "support", least: float = 1.0) -> DataFrame:
    """cells with support (0 where unobserved), observed, interpolated, low_support and risk.

    Risk is 1 where nothing was observed and falls in proportion to 0 where support reaches least.
    """
    seen = F.coalesce(finite(F.col(support).cast("double")) > 0, F.lit(False))
    value = F.when(seen, F.col(support).cast("double")).otherwise(0.0)
    if least > 0:
        low, risk = value < least, F.when(seen, clipped((least - value) / least)).otherwise(1.0)
    else:
        low, risk = ~seen, (~seen).cast("double")
    return cells.withColumns({"support": value, "observed": seen, "interpolated": ~seen, "low_support": low, "risk": risk})


def with_next_row(cells: DataFrame, values: list[str], height: int, periodic: bool = True) -> DataFrame:
    """cells with next_<value>, that of the row below; the first row follows the last of a periodic map, none that of a strip."""
    below = cells.select((F.col("belt_row") - 1).alias("belt_row"), "x", *[F.col(v).alias(f"next_{v}") for v in values])
    if periodic:
        below = below.withColumn("belt_row", F.pmod("belt_row", F.lit(height)))
    return cells.join(below, ["belt_row", "x"], "left")


def sampled_row(row: Column, phase: Column, height: int, periodic: bool = True) -> tuple[Column, Column, Column]:
    """(belt_row, weight of the next row, whether the map has that place) of image rows at a phase."""
    at = row + phase
    if periodic:
        at = F.pmod(at, F.lit(float(height)))
        low = F.floor(at)
        return F.pmod(low, F.lit(height)), at - low, F.lit(True)
    inside = (at >= 0) & (at <= height - 1)
    at = clipped(at, 0.0, float(height - 1))
    low = F.floor(at)
    return low, at - low, inside


def blend(value: str, weight: Column) -> Column:
    """Between a row and the next; a last row without a next stands for itself."""
    return F.when(weight > 0, (1 - weight) * F.col(value) + weight * F.coalesce(f"next_{value}", value)).otherwise(F.col(value))


def render_view(cells: DataFrame, frames: DataFrame, phase: str, rows: int, height: int, value: str = "v", periodic: bool = True) -> DataFrame:
    """frame_index, y, x, value of the surface expected in each frame: rows between map rows are blended.

    Rows outside a strip that doesn't wrap are null.
    """
    asked = frames.select("frame_index", F.col(phase).alias("phase"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("y"))
    row, weight, inside = sampled_row(F.col("y"), F.col("phase"), height, periodic)
    asked = asked.select("frame_index", "y", row.alias("belt_row"), weight.alias("w"), inside.alias("inside"))
    met = asked.join(with_next_row(cells.select("belt_row", "x", value), [value], height, periodic), "belt_row")
    return met.select("frame_index", "y", "x", F.when(F.col("inside"), blend(value, F.col("w"))).alias(value))


def render_mask(cells: DataFrame, frames: DataFrame, phase: str, rows: int, height: int, value: str = "mask", fractional: bool = True, periodic: bool = True) -> DataFrame:
    """frame_index, y, x, value: cells that a mask of the surface covers in each frame.

    With a fractional splat a row is covered where either map row that it lies between is; else where
    the nearest (half up) is. Rows wrap, or are moved to a strip's ends.
    """
    asked = frames.select("frame_index", F.col(phase).alias("phase"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("y"))
    at = F.col("y") + F.col("phase")
    at = F.pmod(at, F.lit(float(height))) if periodic else clipped(at, 0.0, float(height - 1))
    keep = lambda r: F.pmod(r, F.lit(height)) if periodic else F.least(r, F.lit(height - 1))
    low = F.floor(at) if fractional else F.floor(at + 0.5)
    near = F.array_distinct(F.array(keep(low), keep(low + 1))) if fractional else F.array(keep(low))
    met = asked.select("frame_index", "y", F.explode(near).alias("r")).join(cells.select(F.col("belt_row").alias("r"), "x", F.col(value).alias("m")), "r")
    return met.groupBy("frame_index", "y", "x").agg(F.max(F.col("m").cast("int")).cast("boolean").alias(value))


def score_map_risk(
    detections: DataFrame, phases: DataFrame, phase: str, maps: DataFrame, rows: int, width: int, height: int, periodic: bool = True,
    max_risk: float = 1.0, max_interpolated: float = 1.0, max_low: float = 1.0,
) -> DataFrame:
    """detections with support, risk, interpolated and low-support measures of the map under their boxes, and rejected.

    Boxes are cut at the frame; one that has nothing left has null measures and stays. Pixels that the
    map doesn't reach have support 0 and risk 1.
    """
    top, left = F.greatest(F.col("bbox_top"), F.lit(0)), F.greatest(F.col("bbox_left"), F.lit(0))
    bottom, right = F.least(F.col("bbox_bottom"), F.lit(rows)), F.least(F.col("bbox_right"), F.lit(width))
    met = detections.join(phases.select("frame_index", F.col(phase).alias("phase")), "frame_index")
    met = met.where((bottom > top) & (right > left)).select("frame_index", "label", "phase", F.explode(F.sequence(top, bottom - 1)).alias("y"), left.alias("l"), right.alias("r"))
    row, weight, inside = sampled_row(F.col("y"), F.col("phase"), height, periodic)
    met = met.select("frame_index", "label", row.alias("belt_row"), weight.alias("w"), inside.alias("inside"), F.explode(F.sequence("l", F.col("r") - 1)).alias("x"))
    kinds = ("support", "risk", "interpolated", "low_support")
    cells = with_next_row(maps.select("belt_row", "x", *[F.col(k).cast("double").alias(k) for k in kinds]), list(kinds), height, periodic)
    met = met.join(cells, ["belt_row", "x"], "left")
    worst = {"support": 0.0, "risk": 1.0, "interpolated": 1.0, "low_support": 1.0}
    seen = {k: F.coalesce(F.when(F.col("inside"), blend(k, F.col("w"))), F.lit(v)) for k, v in worst.items()}
    found = met.groupBy("frame_index", "label").agg(
        F.min(seen["support"]).alias("map_support_min"), F.avg(seen["support"]).alias("map_support_mean"),
        F.avg(seen["risk"]).alias("map_risk_mean"), F.max(seen["risk"]).alias("map_risk_max"),
        F.avg(clipped(seen["interpolated"])).alias("map_interpolated_fraction"),
        F.avg(clipped(seen["low_support"])).alias("map_low_support_fraction"),
    )
    above = (
        (F.col("map_risk_mean") > max_risk) | (F.col("map_interpolated_fraction") > max_interpolated)
        | (F.col("map_low_support_fraction") > max_low)
    )
    return detections.join(found, ["frame_index", "label"], "left").withColumn("rejected", F.coalesce(above, F.lit(False)))
