"""Frame kernels as operators: each frame is one row, so frames are worked on apart, in Arrow batches.

Frames are (frame_index, height, width, pixels array<double>); null pixels aren't valid.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopsight.kernels import images

#: Bytes of a map that is sent to all executors; a larger one is an error.
MAP_BYTES = 1 << 30
#: Frames of one Arrow batch; a frame may have millions of pixels.
FRAMES = 16

_DETECTION = (
    "label long, y double, x double, area_px long, bbox_top long, bbox_left long, bbox_bottom long, bbox_right long, mean_signal double, peak_signal double"
)
_DETECTION_KIND = pa.struct(
    [("label", pa.int64()), ("y", pa.float64()), ("x", pa.float64()), ("area_px", pa.int64())]
    + [(f"bbox_{s}", pa.int64()) for s in ("top", "left", "bottom", "right")] + [("mean_signal", pa.float64()), ("peak_signal", pa.float64())]
)


def frame_batches(frames: DataFrame) -> None:
    """Has the session hand frames to Python a few at a time; the setting stays."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", frames.sparkSession.conf
    if not 0 < int(conf.get(name)) <= FRAMES:
        conf.set(name, str(FRAMES))


def arrays(height: pa.Array, width: pa.Array, *columns: pa.Array):
    """Each row's columns as arrays of its height and width; null is NaN."""
    for h, w, *rows in zip(height.to_pylist(), width.to_pylist(), *(range(len(c)) for c in columns), strict=True):
        out = []
        for c, i in zip(columns, rows, strict=True):
            v = c[i].values
            out.append(np.full((h, w), np.nan) if v is None else v.to_numpy(zero_copy_only=False).astype(float).reshape(h, w))
        yield out


def _listed(found) -> pa.Array:
    """Arrays as lists, NaN as null."""
    flat = [np.asarray(x, dtype=float).ravel() for x in found]
    return pa.array([pa.array(x, mask=np.isnan(x)) for x in flat], type=pa.list_(pa.float64())) if flat else pa.array([], type=pa.list_(pa.float64()))


def mapped(frames: DataFrame, name: str, function, *columns: str) -> DataFrame:
    """frames with a column of arrays that the function gives for those named."""
    frame_batches(frames)

    @F.arrow_udf("array<double>")
    def of(height: pa.Array, width: pa.Array, *rows: pa.Array) -> pa.Array:
        return _listed(function(*x) for x in arrays(height, width, *rows))

    return frames.withColumn(name, of("height", "width", *columns))


def measured(frames: DataFrame, schema: str, function, *columns: str) -> DataFrame:
    """frame_index and the numbers that the function gives as a dict (or None) for the arrays named."""
    frame_batches(frames)
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.float64() for x in schema.split(",")]
    kind = pa.struct(list(zip(names, kinds, strict=True)))

    @F.arrow_udf(schema)
    def of(height: pa.Array, width: pa.Array, *rows: pa.Array) -> pa.Array:
        return pa.array([function(*x) or dict.fromkeys(names) for x in arrays(height, width, *rows)], type=kind)

    return frames.select("frame_index", of("height", "width", *columns).alias("m")).select("frame_index", "m.*")


def surface_of(cells: DataFrame, height: int, width: int, value: str = "v") -> np.ndarray:
    """A map as an array on the driver, of a size that is checked; cells without a value are NaN."""
    if height * width * 8 > MAP_BYTES:
        raise ValueError("the map is too large to be sent to every executor")
    rows = cells.select("belt_row", "x", value).toPandas()
    out = np.full((height, width), np.nan)
    out[rows["belt_row"].to_numpy(int), rows["x"].to_numpy(int)] = rows[value].to_numpy(float)
    return out


def residuals(frames: DataFrame, image: str = "pixels", expected: str = "expected", **how) -> DataFrame:
    """frames with raw, local_noise and normalized."""
    out = mapped(frames, "raw", lambda a, b: images.residual(a, b, **how)[0], image, expected)
    out = mapped(out, "local_noise", lambda r: images.local_noise(r, **how), "raw")
    return mapped(out, "normalized", lambda r, n: r / n, "raw", "local_noise")


def expected(frames: DataFrame, surface: np.ndarray, phase: str = "phase", periodic: bool = True) -> DataFrame:
    """frames with what the surface should look like at their phase."""
    sent = frames.sparkSession.sparkContext.broadcast(surface)
    frame_batches(frames)

    @F.arrow_udf("array<double>")
    def of(height: pa.Array, at: pa.Array) -> pa.Array:
        return _listed(images.rendered(sent.value, p, h, periodic) for h, p in zip(height.to_pylist(), at.to_pylist(), strict=True))

    return frames.withColumn("expected", of("height", F.col(phase).cast("double")))


def registered(frames: DataFrame, surface: np.ndarray, phase: str = "phase", period: float | None = None, **how) -> DataFrame:
    """frames with r: phase_px, correction_px, loss, score and how sure they are, near the predicted phase."""
    sent = frames.sparkSession.sparkContext.broadcast(surface)
    names = ("phase_px", "correction_px", "loss", "score", "second_best_loss", "loss_gap", "loss_gap_ratio", "loss_curvature", "uncertainty_px")
    kind = pa.struct([(n, pa.float64()) for n in names])
    frame_batches(frames)

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def of(height: pa.Array, width: pa.Array, rows: pa.Array, at: pa.Array) -> pa.Array:
        pairs = zip(arrays(height, width, rows), at.to_pylist(), strict=True)
        return pa.array([images.register(x, sent.value, p, period, **how) for (x,), p in pairs], type=kind)

    return frames.withColumn("r", of("height", "width", "pixels", F.col(phase).cast("double")))


def detections(frames: DataFrame, threshold: float, low: float | None = None, mode: str = "positive", gates: images.Gates = images.Gates(), column: str = "normalized") -> DataFrame:
    """frame_index and the detections of each frame's signal: components above the threshold, grown to the lower one."""
    frame_batches(frames)
    mode = images.mode_of(mode)

    @F.arrow_udf(f"array<struct<{_DETECTION.replace(' ', ':').replace(',:', ', ')}>>")
    def of(height: pa.Array, width: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for (x,) in arrays(height, width, rows):
            mask = images.detected(x, threshold, low, mode=mode)
            out.append(images.components(mask, images.oriented(x, mode), gates))
        return pa.array(out, type=pa.list_(_DETECTION_KIND))

    return frames.select("frame_index", F.inline(of("height", "width", column)))


def masks(frames: DataFrame, mode: str, threshold: float, low: float | None = None, dilation: int = 0, margin: int = 0, min_area: int = 1) -> DataFrame:
    """frames with mask: 1 where a map should leave a pixel out, else 0."""
    mode = images.mode_of(mode)
    return mapped(frames, "mask", lambda x: images.map_mask(np.where(np.isnan(x), -np.inf, images.oriented(x, mode)), "positive", threshold, low, dilation, margin, min_area), "normalized")


def photometric(frames: DataFrame, **how) -> DataFrame:
    """gain, offset, n_pixels, rmse_gray and trimmed_fraction of each frame against what is expected; null where they can't be fitted."""
    names = ("gain", "offset", "n_pixels", "rmse_gray", "trimmed_fraction")
    schema = "gain double, offset double, n_pixels long, rmse_gray double, trimmed_fraction double"
    return measured(frames, schema, lambda a, b: dict(zip(names, f, strict=True)) if (f := images.gain_offset(a, b, **how)) else None, "pixels", "expected")


def corrected(frames: DataFrame, fits: DataFrame) -> DataFrame:
    """frames with what is expected brought to the frame's gain and offset, where there's a fit."""
    fit = fits.select("frame_index", F.col("gain").alias("_g"), F.col("offset").alias("_o"))
    new = F.transform("expected", lambda x: x * F.coalesce("_g", F.lit(1.0)) + F.coalesce("_o", F.lit(0.0)))
    return frames.join(fit, "frame_index", "left").withColumn("expected", new).drop("_g", "_o")


def pair_shifts(frames: DataFrame, most: int, pairs: int | None = None) -> DataFrame:
    """frame_index, shift: how far each frame's image is moved down from the frame before it, of the first pairs."""
    before = frames.select((F.col("frame_index") + 1).alias("frame_index"), F.col("pixels").alias("before"))
    met = frames.where(F.col("frame_index") <= pairs).join(before, "frame_index") if pairs else frames.join(before, "frame_index")
    return measured(met, "shift double", lambda a, b: {"shift": images.vertical_shift(b, a, most)}, "pixels", "before")


def velocity_of(shifts: DataFrame, most: int, least: float = 0.25, edge: float = 0.2) -> float:
    """The median shift; an error where that is too small, or where too many shifts reach the search's edge."""
    v, share = shifts.agg(F.median("shift"), F.avg((F.abs("shift") >= 0.9 * most).cast("double"))).first()
    if v is None or abs(v) < least:
        raise ValueError("the frames don't move")
    if share > edge:
        raise ValueError("shifts often reach the edge of the search")
    return float(v)


def xy_shifts(frames: DataFrame, **how) -> DataFrame:
    names = ("dy", "dx", "loss", "score")
    return measured(frames, "dy long, dx long, loss double, score double", lambda a, b: dict(zip(names, images.xy_shift(a, b, **how), strict=True)), "pixels", "expected")


def density(frames: DataFrame, threshold: float, mode: str = "positive", column: str = "normalized") -> DataFrame:
    """frame_index, density: the share of valid pixels above the threshold; 1 where none is valid."""
    sign = {"positive": lambda x: x, "negative": lambda x: -x, "absolute": F.abs}[images.mode_of(mode)]
    known = F.filter(column, lambda x: x.isNotNull())
    above = F.size(F.filter(known, lambda x: sign(x) > threshold))
    return frames.select("frame_index", F.when(F.size(known) > 0, above / F.size(known)).otherwise(1.0).alias("density"))


def recommended_threshold(pixels: DataFrame, false_per_frame: float, mode: str = "positive", value: str = "v") -> DataFrame:
    """One row: the value that so many pixels a frame exceed."""
    sign = {"positive": lambda x: x, "negative": lambda x: -x, "absolute": F.abs}[images.mode_of(mode)]
    x = sign(F.col(value))
    counts = pixels.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame_index").alias("f")).first()
    share = min(1.0, max(0.0, false_per_frame * counts["f"] / counts["n"])) if counts["n"] else 0.0
    return pixels.agg(F.percentile(x, F.lit(1 - share)).alias("threshold"))


def quality(frames: DataFrame, saturated: float = 250.0, dark: float = 5.0) -> DataFrame:
    names = ("mean", "std", "p01", "p50", "p99", "saturated_share", "dark_share", "laplacian_variance", "gradient_variance")
    return measured(frames, ", ".join(f"{n} double" for n in names), lambda x: images.quality(x, saturated, dark), "pixels")


def texture(frames: DataFrame) -> DataFrame:
    return measured(frames, "std double, gradient_mad double, mad double, p95_abs double", images.texture, "pixels")


def randomized(frames: DataFrame, seed: int, **how) -> DataFrame:
    """frames with noise, gain, blur and scratches drawn anew for each, the same for the same seed and frame."""
    frame_batches(frames)

    @F.arrow_udf("array<double>")
    def of(height: pa.Array, width: pa.Array, rows: pa.Array, numbers: pa.Array) -> pa.Array:
        found = zip(arrays(height, width, rows), numbers.to_pylist(), strict=True)
        return _listed(images.randomized(x, hash((seed, n)) & 0x7FFFFFFF, **how) for (x,), n in found)

    return frames.withColumn("pixels", of("height", "width", "pixels", "frame_index"))


def apply_plugin(frames: DataFrame, spec: str, schema: str, *columns: str, **how) -> DataFrame:
    """frame_index and the rows that a function named module:function gives for each frame's arrays, as dicts of the schema's fields."""
    import importlib

    module, _, name = spec.partition(":")
    function = getattr(importlib.import_module(module), name)
    names = [x.split()[0] for x in schema.split(",")]
    frame_batches(frames)

    @F.arrow_udf("array<string>")
    def of(height: pa.Array, width: pa.Array, *rows: pa.Array) -> pa.Array:
        import json

        return pa.array([[json.dumps({n: d.get(n) for n in names}) for d in function(*x, **how)] for x in arrays(height, width, *rows)], type=pa.list_(pa.string()))

    found = frames.select("frame_index", F.explode(of("height", "width", *columns)).alias("j"))
    return found.select("frame_index", F.from_json("j", schema).alias("d")).select("frame_index", "d.*")
