"""Building the surface map: splats, robust means, gap filling, exposure, seams.

Pixels are (frame_index, y, x, v); phases hold frame_index and a phase; maps are (belt_row, x, v, support).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopsight.functions.cyclic import finite
from loopsight.functions.values import clipped

MAD = 1.4826


def _each(n: int) -> Column:
    """A row for each number from 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def geometry(frames: DataFrame, velocity: float, crop_height: int, period: int | None = None) -> DataFrame:
    """One row: height of the map, reference phase and model period; a strip as long as the frames travel without a period."""
    if period:
        return frames.sparkSession.createDataFrame([(period, 0.0, float(period))], "height long, reference_phase double, period double")
    phase = F.col("frame_index") * -float(velocity)
    low, high = F.min(phase), F.max(phase)
    height = F.greatest(F.ceil(high - low + crop_height + 2), F.lit(crop_height)).cast("long")
    return frames.agg(height.alias("height"), (-low).alias("reference_phase"), F.lit(None).cast("double").alias("period"))


def splat(pixels: DataFrame, phases: DataFrame, phase: str, height: int, linear: bool = True, periodic: bool = True, weight: Column | None = None) -> DataFrame:
    """frame_index, belt_row, x, v, w: each pixel on the rows it falls on, with its part of the pixel's weight.

    A linear splat shares a pixel between two rows by its fraction, else it falls on the nearest, half up.
    Rows wrap at a period; on a strip they are moved to its ends. Pixels without a finite value or a
    positive weight take no part.
    """
    at = F.col("y") + F.col("phase")
    at = F.pmod(at, F.lit(float(height))) if periodic else clipped(at, 0.0, float(height - 1))
    keep = lambda r: F.pmod(r, F.lit(height)) if periodic else F.least(r, F.lit(height - 1))
    rows = pixels.join(phases.select("frame_index", F.col(phase).alias("phase")), "frame_index")
    rows = rows.select("frame_index", "x", finite(F.col("v").cast("double")).alias("v"), at.alias("at"), (F.lit(1.0) if weight is None else weight).alias("pixel"))
    rows = rows.where("v is not null and pixel > 0")
    low, part = F.floor("at"), F.col("at") - F.floor("at")
    if linear:
        spread = F.array(F.struct(keep(low).alias("belt_row"), (1 - part).alias("share")), F.struct(keep(low + 1).alias("belt_row"), part.alias("share")))
    else:
        spread = F.array(F.struct(keep(F.floor(F.col("at") + 0.5)).alias("belt_row"), F.lit(1.0).alias("share")))
    rows = rows.select("frame_index", "x", "v", "pixel", F.inline(spread)).where("share > 0")
    return rows.select("frame_index", "belt_row", "x", "v", (F.col("share") * F.col("pixel")).alias("w"))


def mean_map(samples: DataFrame) -> DataFrame:
    """Weighted mean and support of each cell that samples reach."""
    return samples.groupBy("belt_row", "x").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"), F.sum("w").alias("support"))


def robust_map(samples: DataFrame, trim: float, estimator: str = "trimmed_mean") -> DataFrame:
    """Weighted mean of each cell's values by frame, less the floor(trim * n) lowest and highest (or these moved to the next).

    A frame's own samples of a cell are one value with their weight; equal values are ranked by frame.
    Cells of one value keep it.
    """
    if estimator not in ("trimmed_mean", "winsorized_mean"):
        raise ValueError("estimator is trimmed_mean or winsorized_mean")
    each = samples.groupBy("belt_row", "x", "frame_index").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"), F.sum("w").alias("w"))
    cell = Window.partitionBy("belt_row", "x")
    each = each.withColumn("n", F.count(F.lit(1)).over(cell)).withColumn("rank", F.row_number().over(cell.orderBy("v", "frame_index")))
    each = each.withColumn("cut", F.floor(F.col("n") * trim))
    inside = (F.col("rank") > F.col("cut")) & (F.col("rank") <= F.col("n") - F.col("cut"))
    if estimator == "winsorized_mean":
        low = F.max(F.when(F.col("rank") == F.col("cut") + 1, F.col("v"))).over(cell)
        high = F.max(F.when(F.col("rank") == F.col("n") - F.col("cut"), F.col("v"))).over(cell)
        each = each.withColumns({"low": low, "high": high}).withColumn("v", F.least(F.greatest("v", "low"), F.col("high")))
    else:
        each = each.where(inside)
    return mean_map(each)


def robust_scale(values: Column, middle: Column, least: float) -> Column:
    """An aggregate: 1.4826 times the median distance from a given middle, at least `least`; `least` for fewer than two values."""
    mad = F.median(F.abs(values - middle))
    return F.when((F.count(values) >= 2) & (mad > 0), F.greatest(mad * MAD, F.lit(float(least)))).otherwise(F.lit(float(least)))


def huber_weights(residuals: DataFrame, delta: float = 1.5, least: float = 1.0) -> DataFrame:
    """residuals (frame_index, y, x, raw) with weight: 1 near a frame's median, cutoff over distance beyond delta robust scales."""
    known = residuals.withColumn("raw", finite(F.col("raw").cast("double"))).where("raw is not null")
    middle = known.groupBy("frame_index").agg(F.median("raw").alias("middle"))
    scale = known.join(middle, "frame_index").groupBy("frame_index", "middle").agg(robust_scale(F.col("raw"), F.col("middle"), least).alias("scale"))
    out = known.join(scale, "frame_index")
    off, cutoff = F.abs(F.col("raw") - F.col("middle")), F.col("scale") * delta
    return out.withColumn("weight", F.when(off > cutoff, cutoff / off).otherwise(1.0)).drop("middle", "scale")


def fill_gaps(cells: DataFrame, height: int, width: int, periodic: bool = True) -> DataFrame:
    """belt_row, x, v, support of every cell: gaps are interpolated along each column.

    Around the turn if periodic; beyond the ends of a strip the last value stays. A column without
    cells gets the weighted mean of all.
    """
    spark = cells.sparkSession
    grid = spark.range(height).withColumnRenamed("id", "belt_row").withColumn("x", _each(width))
    total = cells.agg((F.sum(F.col("support") * F.col("v")) / F.sum("support")).alias("mean"))
    known = cells.select("belt_row", "x", "v", "support")
    rows = grid.join(known, ["belt_row", "x"], "left").withColumn("r", F.col("belt_row"))
    if periodic:
        turns = F.explode(F.array(F.lit(-height), F.lit(0), F.lit(height)))
        more = known.select("belt_row", "x", "v", "support").withColumn("turn", turns).where("turn <> 0")
        rows = rows.unionByName(more.select(F.lit(None).cast("long").alias("belt_row"), "x", "v", "support", (F.col("belt_row") + F.col("turn")).alias("r")))
    before = Window.partitionBy("x").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("x").orderBy("r").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("v").isNotNull(), F.struct("r", "v"))
    rows = rows.withColumns({"low": F.last(at, True).over(before), "high": F.first(at, True).over(after)}).where("belt_row is not null")
    part = (F.col("r") - F.col("low.r")) / (F.col("high.r") - F.col("low.r"))
    between = F.col("low.v") + (F.col("high.v") - F.col("low.v")) * part
    value = F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("low").isNull(), F.col("high.v")).when(F.col("high").isNull(), F.col("low.v")).otherwise(between)
    out = rows.withColumn("filled", value).join(total)  # one row
    return out.select("belt_row", "x", F.coalesce("filled", "mean").alias("v"), F.coalesce("support", F.lit(0.0)).alias("support"))


def row_counts(phases: DataFrame, phase: str, height: int, rows: int, periodic: bool = True) -> DataFrame:
    """belt_row, n: how often frames show each row of the map, every image row counting for the row it lies on."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.floor(r + F.col(phase))))
    seen = phases.select(at.alias("belt_row"))
    seen = seen.withColumn("belt_row", F.pmod("belt_row", F.lit(height))) if periodic else seen.where(F.col("belt_row").between(0, height - 1))
    return seen.groupBy("belt_row").agg(F.count(F.lit(1)).alias("n"))


def row_coverage(phases: DataFrame, phase: str, height: int, rows: int, periodic: bool = True) -> DataFrame:
    """belt_row, exposure: as row_counts, but an image row counts for two rows by its fraction."""
    at = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    seen = phases.select(F.col(phase).alias("phase"), at.alias("y")).withColumn("at", F.col("y") + F.col("phase"))
    low, part = F.floor("at"), F.col("at") - F.floor("at")
    spread = F.array(F.struct(low.alias("belt_row"), (1 - part).alias("w")), F.struct((low + 1).alias("belt_row"), part.alias("w")))
    seen = seen.select(F.inline(spread)).where("w > 0")
    seen = seen.withColumn("belt_row", F.pmod("belt_row", F.lit(height))) if periodic else seen.where(F.col("belt_row").between(0, height - 1))
    return seen.groupBy("belt_row").agg(F.sum("w").alias("exposure"))


def seam_profile(cells: DataFrame, height: int, window: int = 8) -> DataFrame:
    """belt_row, jump: mean distance, over columns, of the `window` rows from a row on from as many before it, in order.

    Rows wrap; the window is half the map at most.
    """
    window = max(1, min(window, max(1, height // 2)))
    rows = cells.select("belt_row", "x", "v").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
    after = rows.select(F.pmod(F.col("belt_row") - F.col("i"), F.lit(height)).alias("seam"), F.pmod(F.col("belt_row") - window, F.lit(height)).alias("belt_row"), "x", F.col("v").alias("a"))
    met = after.join(cells.select("belt_row", "x", "v"), ["belt_row", "x"])
    return met.groupBy(F.col("seam").alias("belt_row")).agg(F.avg(F.abs(F.col("a") - F.col("v"))).alias("jump"))


def seam_summary(profile: DataFrame) -> DataFrame:
    """One row: the jump at row 0, the row with the smallest (the first of equals), by how much that's better, and the spread of jumps."""
    out = profile.agg(
        F.max(F.when(F.col("belt_row") == 0, F.col("jump"))).alias("current_mean_abs_jump_gray"), F.min(F.struct("jump", "belt_row")).alias("best"),
        F.percentile("jump", F.lit(0.95)).alias("p95_row_jump_gray"), F.median("jump").alias("median_row_jump_gray"),
    )
    now, best = F.col("current_mean_abs_jump_gray"), F.col("best.jump")
    return out.select(
        now, F.col("best.belt_row").alias("best_roll_row"), best.alias("best_mean_abs_jump_gray"),
        F.when(now > 0, (now - best) / now).alias("relative_improvement"), "p95_row_jump_gray", "median_row_jump_gray",
    )


def seam_at(cells: DataFrame, height: int, row: int = 0, window: int = 8) -> DataFrame:
    """One row: mean and 95th percentile of the jump across one row, and the mean distance of the rows mirrored about it."""
    row %= height
    near = cells.select("belt_row", "x", "v").withColumn("i", F.pmod(F.col("belt_row") - row, F.lit(height)))
    after = near.where(F.col("i") < window).select("i", "x", F.col("v").alias("a"))
    before = near.withColumn("i", F.pmod(row - 1 - F.col("belt_row"), F.lit(height))).where(F.col("i") < window)
    off = F.abs(F.col("a") - F.col("v"))
    jump = F.when(F.col("i") == 0, off)
    return after.join(before, ["i", "x"]).agg(
        F.lit(row).alias("seam_row"), F.avg(jump).alias("mean_abs_jump_gray"), F.percentile(jump, F.lit(0.95)).alias("p95_abs_jump_gray"),
        F.avg(off).alias("window_mean_abs_difference_gray"),
    )


def smoothed_corrections(corrections: DataFrame, frames: int, window: int, by: list[str]) -> DataFrame:
    """by, frame_index, smoothed for frames 0 to frames - 1: gaps interpolated, ends kept, then the running median of `window` frames.

    corrections are (by, frame_index, correction), null or missing where unknown; a sequence without any is 0.
    """
    spark = corrections.sparkSession
    keys = corrections.select(*by).distinct() if by else spark.range(1).select()
    grid = keys.withColumn("frame_index", _each(frames))
    known = corrections.select(*by, "frame_index", finite(F.col("correction").cast("double")).alias("c"))
    rows = grid.join(known, [*by, "frame_index"], "left")
    order = Window.partitionBy(*by).orderBy("frame_index")
    at = F.when(F.col("c").isNotNull(), F.struct(F.col("frame_index").alias("r"), F.col("c").alias("v")))
    low = F.last(at, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(at, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"low": low, "high": high})
    gap = F.col("high.r") - F.col("low.r")
    between = F.when(gap > 0, F.col("low.v") + (F.col("high.v") - F.col("low.v")) * (F.col("frame_index") - F.col("low.r")) / gap).otherwise(F.col("low.v"))
    filled = F.coalesce(between, F.col("low.v"), F.col("high.v"), F.lit(0.0))
    rows = rows.select(*by, "frame_index", filled.alias("filled"))
    if window <= 1:
        return rows.withColumnRenamed("filled", "smoothed")
    half = max(1, window // 2)
    near = F.sort_array(F.collect_list("filled").over(order.rowsBetween(-half, half)))
    rows = rows.withColumn("near", near)
    middle = (F.get("near", F.floor((F.size("near") - 1) / 2).cast("int")) + F.get("near", F.floor(F.size("near") / 2).cast("int"))) / 2
    return rows.withColumn("smoothed", middle).drop("filled", "near")


def pixel_medians(residuals: DataFrame) -> DataFrame:
    """y, x, background: each pixel's median over frames; pixels that are never finite are left out."""
    return residuals.withColumn("raw", finite(F.col("raw").cast("double"))).groupBy("y", "x").agg(F.median("raw").alias("background")).where("background is not null")


def pixel_noise(residuals: DataFrame, least: float = 1e-6) -> DataFrame:
    """y, x, noise: 1.4826 times each pixel's median distance from its median over frames, at least `least`."""
    known = residuals.withColumn("raw", finite(F.col("raw").cast("double"))).where("raw is not null")
    off = known.join(pixel_medians(known), ["y", "x"]).withColumn("off", F.abs(F.col("raw") - F.col("background")))
    return off.groupBy("y", "x").agg(F.greatest(F.median("off") * MAD, F.lit(least)).alias("noise"))


def pixel_means(pixels: DataFrame) -> DataFrame:
    """y, x, v: the plain mean over frames."""
    return pixels.groupBy("y", "x").agg(F.avg("v").alias("v"))


def residual_against(pixels: DataFrame, background: DataFrame) -> DataFrame:
    """frame_index, y, x, raw: pixels less a background of the image (y, x, v)."""
    return pixels.join(background.select("y", "x", F.col("v").alias("b")), ["y", "x"]).select("frame_index", "y", "x", (F.col("v") - F.col("b")).alias("raw"))


def frame_zscores(pixels: DataFrame, least: float = 1e-6) -> DataFrame:
    """frame_index, y, x, raw, normalized: pixels less their frame's median, and that over the frame's robust scale."""
    middle = pixels.groupBy("frame_index").agg(F.median("v").alias("m"))
    off = pixels.join(middle, "frame_index").withColumn("raw", F.col("v") - F.col("m"))
    scale = off.groupBy("frame_index").agg(F.greatest(F.median(F.abs("raw")) * MAD, F.lit(least)).alias("s"))
    return off.join(scale, "frame_index").select("frame_index", "y", "x", "raw", (F.col("raw") / F.col("s")).alias("normalized"))


def noise_floor(residuals: DataFrame, static: DataFrame) -> DataFrame:
    """residuals (raw, local_noise, ...) with local_noise at least the pixel's static noise, and normalized anew."""
    out = residuals.join(static.select("y", "x", "noise"), ["y", "x"], "left")
    floor = F.greatest(F.col("local_noise"), F.coalesce("noise", F.lit(0.0)))
    return out.withColumn("local_noise", floor).withColumn("normalized", F.col("raw") / F.col("local_noise")).drop("noise")


def illumination_field(residuals: DataFrame, height: int, width: int, tile: int) -> DataFrame:
    """frame_index, y, x, field: medians of tiles, interpolated between the tiles' middles and constant beyond the outer ones.

    residuals are valid pixels only; a tile without any has the frame's median.
    """
    known = residuals.withColumn("raw", finite(F.col("raw").cast("double"))).where("raw is not null")
    whole = known.groupBy("frame_index").agg(F.median("raw").alias("all"))
    spark = residuals.sparkSession
    ny, nx = -(-height // tile), -(-width // tile)
    tiles = spark.range(ny).withColumnRenamed("id", "ty").withColumn("tx", _each(nx))
    medians = known.groupBy("frame_index", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).agg(F.median("raw").alias("m"))
    every = whole.join(F.broadcast(tiles)).join(medians, ["frame_index", "ty", "tx"], "left").select("frame_index", "ty", "tx", F.coalesce("m", "all").alias("m"))
    table = every.groupBy("frame_index").agg(F.map_from_entries(F.collect_list(F.struct(F.col("ty") * nx + F.col("tx"), "m"))).alias("tiles"))

    def side(at: str, size: int, n: int) -> tuple[Column, Column, Column]:
        """(tile before, tile after, part of the way) of a place among the tiles' middles."""
        middle = lambda i: 0.5 * (i * tile + F.least(F.lit(size), (i + 1) * tile) - 1)
        own = F.floor(F.col(at) / tile)
        low = F.greatest(F.lit(0), F.when(F.col(at) < middle(own), own - 1).otherwise(own))
        high = F.least(low + 1, F.lit(n - 1))
        part = F.when(F.col(at) <= middle(low), 0.0).when(high == low, 0.0).otherwise((F.col(at) - middle(low)) / F.greatest(middle(high) - middle(low), F.lit(1e-9)))
        return low, high, part

    grid = spark.range(height).withColumnRenamed("id", "y").withColumn("x", _each(width))
    (y0, y1, b), (x0, x1, a) = side("y", height, ny), side("x", width, nx)
    grid = grid.select("y", "x", y0.alias("y0"), y1.alias("y1"), b.alias("b"), x0.alias("x0"), x1.alias("x1"), a.alias("a"))
    out = table.join(F.broadcast(grid))  # the grid of one frame
    get = lambda y, x: F.col("tiles")[F.col(y) * nx + F.col(x)]
    row = lambda y: get(y, "x0") + (get(y, "x1") - get(y, "x0")) * F.col("a")
    return out.select("frame_index", "y", "x", (row("y0") + (row("y1") - row("y0")) * F.col("b")).alias("field"))


def best_roll(cells: DataFrame, other: DataFrame, height: int) -> DataFrame:
    """shift, n, rmse: the cyclic shift of rows that brings a map nearest to another; most common cells first, then rmse, then shift."""
    a = cells.select("belt_row", "x", finite(F.col("v").cast("double")).alias("v")).where("v is not null")
    b = other.select(F.col("belt_row").alias("r"), "x", finite(F.col("v").cast("double")).alias("o")).where("o is not null")
    met = a.join(b, "x").withColumn("shift", F.pmod(F.col("r") - F.col("belt_row"), F.lit(height)))
    d = F.col("v") - F.col("o")
    by = met.groupBy("shift").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"))
    return by.orderBy(F.desc("n"), "rmse", "shift").limit(1)


def marked_cells(boxes: DataFrame, phase: str, height: int, width: int, margin: int = 0, rows: int | None = None) -> DataFrame:
    """belt_row, x, n: how many boxes, grown by margin, mark each cell; each row of a box marks both map rows it lies between.

    Boxes are cut at the image's sides and upper edge, and at its lower one where rows is given.
    """
    top = F.greatest(F.floor("bbox_top") - margin, F.lit(0))
    bottom = F.ceil("bbox_bottom") + margin
    bottom = bottom if rows is None else F.least(bottom, F.lit(rows))
    left, right = F.greatest(F.floor("bbox_left") - margin, F.lit(0)), F.least(F.ceil("bbox_right") + margin, F.lit(width))
    some = boxes.where((bottom > top) & (right > left)).select(F.col(phase).alias("phase"), F.explode(F.sequence(top, bottom - 1)).alias("y"), left.alias("l"), right.alias("r"))
    low = F.floor(F.pmod(F.col("y") + F.col("phase"), F.lit(float(height))))
    some = some.select(F.explode(F.array(F.pmod(low, F.lit(height)), F.pmod(low + 1, F.lit(height)))).alias("belt_row"), "l", "r")
    some = some.select("belt_row", F.explode(F.sequence("l", F.col("r") - 1)).alias("x"))
    return some.groupBy("belt_row", "x").agg(F.count(F.lit(1)).alias("n"))


def defect_map(marks: DataFrame) -> DataFrame:
    """marks with the share of the largest count as probability; every marked cell is a defect."""
    return marks.join(marks.agg(F.max("n").alias("most"))).select("belt_row", "x", "n", (F.col("n") / F.col("most")).alias("probability"), F.lit(True).alias("mask"))


def inpaint(cells: DataFrame, masked: DataFrame, radius: int, height: int) -> DataFrame:
    """cells with masked ones replaced by the median of unmasked cells within radius rows (which wrap) and columns, else of the whole map."""
    holes = masked.select("belt_row", "x").distinct()
    known = cells.where(finite(F.col("v").cast("double")).isNotNull())
    good = known.join(holes, ["belt_row", "x"], "left_anti").select("belt_row", "x", "v")
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    asked = holes.select("belt_row", "x", F.explode(F.array_distinct(F.transform(reach, lambda d: F.pmod(F.col("belt_row") + d, F.lit(height))))).alias("r"))
    asked = asked.select(F.col("belt_row").alias("hr"), F.col("x").alias("hx"), F.col("r").alias("belt_row"), F.explode(reach).alias("dx"))
    asked = asked.select("hr", "hx", "belt_row", (F.col("hx") + F.col("dx")).alias("x"))
    found = asked.join(good, ["belt_row", "x"]).groupBy(F.col("hr").alias("belt_row"), F.col("hx").alias("x")).agg(F.median("v").alias("new"))
    found = holes.join(found, ["belt_row", "x"], "left").join(known.agg(F.median("v").alias("all")))  # one row
    out = cells.join(found.select("belt_row", "x", F.coalesce("new", "all").alias("new")), ["belt_row", "x"], "left")
    return out.withColumn("v", F.coalesce("new", "v")).drop("new")


def estimate_period(profile: DataFrame, least: int, most: int, k: int = 5) -> DataFrame:
    """lag, n, score: normalized autocorrelation of a profile (belt_row, v) at each lag over pairs that are both known; the best k.

    Each lag's pairs are centred by the profile's mean. Ties go to the shorter lag.
    """
    known = profile.select("belt_row", finite(F.col("v").cast("double")).alias("v")).where("v is not null")
    centred = known.join(known.agg(F.avg("v").alias("m"))).select("belt_row", (F.col("v") - F.col("m")).alias("v"))
    lags = centred.withColumn("lag", F.explode(F.sequence(F.lit(least), F.lit(most))))
    met = lags.select((F.col("belt_row") + F.col("lag")).alias("belt_row"), "lag", F.col("v").alias("a")).join(centred, "belt_row")
    by = met.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * F.col("v")).alias("s"), F.sum(F.col("a") * F.col("a")).alias("p"), F.sum(F.col("v") * F.col("v")).alias("q"))
    size = F.sqrt(F.col("p") * F.col("q"))
    by = by.where("n >= 2").select("lag", "n", F.when(size > 0, F.col("s") / size).otherwise(0.0).alias("score"))
    return by.orderBy(F.desc("score"), "lag").limit(k)


def row_profile(cells: DataFrame) -> DataFrame:
    return cells.groupBy("belt_row").agg(F.avg(finite(F.col("v").cast("double"))).alias("v"))
