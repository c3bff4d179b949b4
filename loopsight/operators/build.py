"""From frames to velocities: the surface map in passes, then residuals, detections, tracks and their speeds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.kernels.images import Gates
from loopsight.operators import evaluation, frames as kernels, maps, tracking, velocity
from loopsight.operators.ordered import stored
from loopsight.sources import images


def _filled(samples: DataFrame, height: int, width: int, periodic: bool, aggregation: str, trim: float) -> DataFrame:
    cells = maps.mean_map(samples) if aggregation == "mean" else maps.robust_map(samples, trim, aggregation)
    return stored(maps.fill_gaps(cells, height, width, periodic))


def build_map(
    frames: DataFrame, height: int, width: int, rows: int, periodic: bool = True, linear: bool = True, aggregation: str = "mean", trim: float = 0.1,
    mask_passes: int = 0, threshold: float = 5.0, mode: str = "positive", dilation: int = 0, margin: int = 0, huber_passes: int = 0, delta: float = 1.5,
    feedback_passes: int = 0, period: float | None = None, offsets: bool = False, tile: int | None = None, registration: dict | None = None, noise: dict | None = None,
) -> DataFrame:
    """belt_row, x, v, support of the surface that frames (with their phase) show.

    First all pixels; then, with phases registered against that map and smoothed, as often as asked;
    then without particles found against the map before; then with Huber's weights. Frames may be
    brought to the map's level, by their median offset or by a field of tile medians.
    """
    frames = frames.withColumn("phase", F.col("phase").cast("double"))
    surface = _filled(maps.splat(images.pixels(frames), frames, "phase", height, linear, periodic), height, width, periodic, aggregation, trim)
    for _ in range(feedback_passes):
        seen = kernels.registered(frames, kernels.surface_of(surface, height, width), "phase", period, **(registration or {}))
        known = seen.select("frame_index", F.col("r.correction_px").alias("correction"), F.lit(0).alias("run"))
        n = frames.agg(F.max("frame_index")).first()[0] + 1
        moved = maps.smoothed_corrections(known, n, 5, ["run"]).select("frame_index", "smoothed")
        phase = F.col("phase") + F.coalesce("smoothed", F.lit(0.0))
        frames = stored(frames.join(moved, "frame_index", "left").withColumn("phase", F.pmod(phase, F.lit(float(period))) if period else phase).drop("smoothed"))
        surface = _filled(maps.splat(images.pixels(frames), frames, "phase", height, linear, periodic), height, width, periodic, aggregation, trim)
    for turn in range(mask_passes + huber_passes):
        seen = kernels.residuals(kernels.expected(frames, kernels.surface_of(surface, height, width), "phase", periodic), **(noise or {}))
        whole = seen
        if mask_passes:
            whole = kernels.masks(seen, mode, threshold, dilation=dilation, margin=margin)
            whole = whole.withColumn("pixels", F.zip_with("pixels", "mask", lambda p, m: F.when(m < 0.5, p)))
        values = images.pixels(whole)
        off = images.pixels(whole, "raw", "raw")
        if tile:
            field = maps.illumination_field(off, rows, width, tile)
            values = values.join(field, ["frame_index", "y", "x"]).withColumn("v", F.col("v") - F.col("field")).drop("field")
        elif offsets:
            level = off.groupBy("frame_index").agg(F.median("raw").alias("level"))
            values = values.join(level, "frame_index").withColumn("v", F.col("v") - F.coalesce("level", F.lit(0.0))).drop("level")
        weight = None
        if turn >= mask_passes:
            weights = maps.huber_weights(off, delta).select("frame_index", "y", "x", "weight")
            values, weight = values.join(weights, ["frame_index", "y", "x"]), F.col("weight")
        surface = _filled(maps.splat(values, frames, "phase", height, linear, periodic, weight), height, width, periodic, "mean" if weight is not None else aggregation, trim)
    return surface


def detect(frames: DataFrame, surface, threshold: float = 5.0, low: float | None = None, mode: str = "positive", gates: Gates = Gates(min_area=4), periodic: bool = True, **noise) -> DataFrame:
    """Detections of frames (with their phase) against a surface map."""
    seen = kernels.residuals(kernels.expected(frames, surface, "phase", periodic), **noise)
    return kernels.detections(seen, threshold, low, mode, gates)


def velocities(detections: DataFrame, belt_velocity: float, gate: float, max_gap: float = 1.0, least: int = 2, seq: str | None = None) -> DataFrame:
    """Tracks of detections as velocities with their gates; tracks of fewer than `least` rows are left out."""
    tracked = detections.join(tracking.track(detections, gate, max_gap, 0.8 * belt_velocity, seq=seq).drop("seq"), ["frame_index", "label"])
    rows = velocity.least_squares(tracked, belt_velocity).where(F.col("n_detections") >= least).where("v_y is not null")
    return evaluation.score_velocities(rows)


def run(frames: DataFrame, belt_velocity: float, rows: int, width: int, period: int | None = None, threshold: float = 5.0, mode: str = "positive",
        gates: Gates = Gates(min_area=4), gate: float | None = None, build: dict | None = None, registration: dict | None = None, noise: dict | None = None) -> dict[str, DataFrame]:
    """A sequence's map, phases, detections, tracks and velocities.

    Phases follow the belt's velocity, then registration against the map; frames are worked on apart.
    """
    size = maps.geometry(frames, belt_velocity, rows, period).first()
    height, periodic = int(size["height"]), size["period"] is not None
    phase = F.lit(size["reference_phase"]) - F.lit(float(belt_velocity)) * F.col("frame_index")
    frames = stored(frames.withColumn("phase", F.pmod(phase, F.lit(size["period"])) if periodic else phase))
    surface = build_map(frames, height, width, rows, periodic, period=size["period"], noise=noise, **(build or {}))
    array = kernels.surface_of(surface, height, width)
    seen = stored(kernels.registered(frames, array, "phase", size["period"], **(registration or {})))
    phases = seen.select("frame_index", F.col("phase").alias("predicted_phase_px"), "r.*")
    placed = seen.withColumn("phase", F.coalesce("r.phase_px", "phase")).drop("r")
    found = stored(detect(placed, array, threshold, None, mode, gates, periodic, **(noise or {})))
    reach = gate if gate is not None else max(5.0, 1.5 * abs(belt_velocity))
    links = tracking.track(found, reach, 1.0, 0.8 * belt_velocity).drop("seq")
    return {"map": surface, "phases": phases, "detections": found, "tracks": found.join(links, ["frame_index", "label"]), "velocities": velocities(found, belt_velocity, reach)}


def sweep(grid: dict[str, list], runner) -> list[dict]:
    """runner(**settings) of every combination of the grid's values; each result with its settings."""
    from itertools import product

    return [dict(zip(grid, v, strict=True)) | {"result": runner(**dict(zip(grid, v, strict=True)))} for v in product(*grid.values())]
