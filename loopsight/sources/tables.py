"""Tables of a run in files: CSV, JSON, progress logs, labels; reading what may be missing, and writing in a fixed order."""

import json
import math
import tomllib
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from loopsight.functions import boxes, values
from loopsight.functions.cyclic import finite

#: Other names of the fields of label rows, the first that has a value counting. Fixed values.
ALIASES = {
    "frame_index": ("frame_index", "frame", "image_index", "source_frame_index"),
    "bbox_top": ("bbox_top", "top", "y_min", "ymin", "y0"), "bbox_left": ("bbox_left", "left", "x_min", "xmin", "x0"),
    "bbox_bottom": ("bbox_bottom", "bottom", "y_max", "ymax", "y1"), "bbox_right": ("bbox_right", "right", "x_max", "xmax", "x1"),
    "tracklet_id": ("tracklet_id", "track_id", "event_id", "id"),
}
#: Fields of each table, in the order in which they are written. Fixed values.
FIELDS = {
    "detections_per_frame": ("frame_index", "n_detections"),
    "detections": (
        "frame_index", "image", "label", "y", "x", "area_px", "bbox_top", "bbox_left", "bbox_bottom", "bbox_right", "mean_signal", "peak_signal",
        "map_support_min", "map_support_mean", "map_risk_mean", "map_risk_max", "map_interpolated_fraction", "map_low_support_fraction",
        "recurrent_artifact_overlap_fraction", "recurrent_artifact_probability", "recurrent_artifact_required_peak_signal",
    ),
}


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of CSV files with a header, all text unless a schema says otherwise; none where the path doesn't exist."""
    try:
        reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
        return reader.schema(schema).csv(path) if schema else reader.csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema or "frame_index string")


def read_json(path: str) -> dict:
    """The object of a small JSON file; empty where there's none, or something else."""
    p = Path(path)
    if not p.is_file():
        return {}
    found = json.loads(p.read_text(encoding="utf-8"))
    return found if isinstance(found, dict) else {}


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Events of a progress log, a JSON object a line; lines that aren't are left out."""
    schema = "time string, stage string, message string, elapsed_s double, frames long, peak_rss_mb double"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_config(path: str) -> dict:
    """A TOML or JSON file of settings."""
    p = Path(path)
    return tomllib.loads(p.read_text(encoding="utf-8")) if p.suffix == ".toml" else json.loads(p.read_text(encoding="utf-8"))


def flattened(config: dict, prefix: str = "") -> dict:
    """Settings by dotted name."""
    out: dict = {}
    for key, value in config.items():
        out |= flattened(value, f"{prefix}{key}.") if isinstance(value, dict) else {f"{prefix}{key}": value}
    return out


def resolved(*layers: dict) -> dict:
    """Settings of several layers, later ones counting more; None says nothing."""
    out: dict = {}
    for layer in layers:
        out |= {k: v for k, v in layer.items() if v is not None}
    return out


def extract_zip(archive: str, folder: str) -> list[str]:
    """The archive's files, written below the folder; an error for names that lead out of it or stand twice."""
    root = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        names = [i.filename for i in z.infolist() if not i.is_dir()]
        targets = [(root / n).resolve() for n in names]
        if any(root not in t.parents for t in targets):
            raise ValueError("a name leads out of the folder")
        if len(set(targets)) < len(targets):
            raise ValueError("a name stands twice")
        z.extractall(root)
    return names


def _first(rows: DataFrame, name: str) -> Column:
    known = {c.lower(): c for c in rows.columns}
    there = [F.col(f"`{known[a]}`") for a in ALIASES[name] if a in known]
    return F.coalesce(*[values.number(c) for c in there]) if there else F.lit(None).cast("double")


def label_boxes(rows: DataFrame) -> DataFrame:
    """frame_index, box and tracklet_id of label rows with any of the known field names; a row without a box is a scored, empty frame.

    Rows without a whole frame number are left out; a box without a height or width is none.
    """
    frame = _first(rows, "frame_index")
    sides = {s: _first(rows, s) for s in ("bbox_top", "bbox_left", "bbox_bottom", "bbox_right")}
    known = {c.lower(): c for c in rows.columns}
    ids = [F.col(f"`{known[a]}`").cast("string") for a in ALIASES["tracklet_id"] if a in known]
    key = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in ids]) if ids else F.lit(None).cast("string")
    out = rows.select(frame.alias("f"), *[c.alias(s) for s, c in sides.items()], key.alias("tracklet_id")).where("f = floor(f)")
    some = (F.col("bbox_bottom") > F.col("bbox_top")) & (F.col("bbox_right") > F.col("bbox_left"))
    box = [F.when(F.coalesce(some, F.lit(False)), F.col(s)).alias(s) for s in sides]
    return out.select(F.col("f").cast("long").alias("frame_index"), *box, "tracklet_id")


_BOX = (
    "struct<frame_index: string, frame: string, top: string, left: string, bottom: string, right: string, bbox_top: string, bbox_left: string, "
    "bbox_bottom: string, bbox_right: string, event_id: string, track_id: string, tracklet_id: string>"
)
_LABELS = (
    f"status string, scored_frames array<string>, particles array<{_BOX}>, labels array<{_BOX}>, boxes array<{_BOX}>, "
    f"frames array<struct<frame_index: string, frame: string, boxes: array<{_BOX}>, particles: array<{_BOX}>>>, "
    f"tracklets array<struct<tracklet_id: string, track_id: string, id: string, boxes: array<{_BOX}>>>"
)


def labels_from_json(texts: DataFrame, text: str = "value") -> DataFrame:
    """status, frame_index, box, tracklet_id of label files (one JSON text a row): flat lists, frames with boxes, or tracklets with boxes.

    Frames that are scored without a box have a row without one. Numbers may be text.
    """
    doc = F.from_json(F.col(text), _LABELS)
    docs = texts.select(doc.alias("d")).select("d.*").withColumn("doc", F.monotonically_increasing_id())

    def rows(items: DataFrame, frame: Column, key: Column) -> DataFrame:
        b = lambda n: values.number(F.coalesce(F.col(f"b.bbox_{n}"), F.col(f"b.{n}"))).alias(f"bbox_{n}")
        return items.select("status", values.number(frame).alias("f"), b("top"), b("left"), b("bottom"), b("right"), key.alias("tracklet_id"))

    own = F.coalesce("b.frame_index", "b.frame")
    name = F.coalesce("b.tracklet_id", "b.track_id", "b.event_id")
    flat = F.flatten(F.array_compact(F.array("particles", "labels", "boxes")))
    out = rows(docs.select("status", F.explode(flat).alias("b")), own, name)
    inner = docs.select("status", F.explode("frames").alias("fr"))
    either = F.flatten(F.array_compact(F.array("fr.boxes", "fr.particles")))
    of_frame = F.coalesce("fr.frame_index", "fr.frame")
    out = out.unionByName(rows(inner.select("status", of_frame.alias("own"), F.explode_outer(either).alias("b")), F.coalesce(F.col("own"), own), name))
    tracked = docs.select("status", F.explode("tracklets").alias("t")).select("status", F.coalesce("t.tracklet_id", "t.track_id", "t.id").alias("key"), F.explode("t.boxes").alias("b"))
    out = out.unionByName(rows(tracked, own, F.coalesce("key", name)))
    sides = [f"bbox_{s}" for s in boxes.SIDES]
    scored = docs.select("status", F.explode("scored_frames").alias("f")).select("status", values.number(F.col("f")).alias("f"), *[F.lit(None).cast("double").alias(s) for s in sides], F.lit(None).cast("string").alias("tracklet_id"))
    out = out.unionByName(scored.join(out.select("f"), "f", "left_anti"))
    return out.where("f = floor(f)").select("status", F.col("f").cast("long").alias("frame_index"), *sides, "tracklet_id")


def label_errors(labels: DataFrame, frames: int | None = None, height: int | None = None, width: int | None = None) -> DataFrame:
    """frame_index, tracklet_id and errors of each label row that is wrong: no frame, no extent, outside of the image or sequence."""
    t, left, b, r = boxes.sides("bbox_")
    some = t.isNotNull() | left.isNotNull() | b.isNotNull() | r.isNotNull()
    checks = [
        (F.col("frame_index").isNull() | (F.col("frame_index") < 0), "frame_index is missing or negative"),
        (some & (t.isNull() | left.isNull() | b.isNull() | r.isNull()), "box is incomplete"), (some & ((b <= t) | (r <= left)), "box has no extent"),
        (some & ((t < 0) | (left < 0)), "box begins outside of the image"),
    ]
    if frames is not None:
        checks.append((F.col("frame_index") >= frames, "frame_index is beyond the sequence"))
    if height is not None and width is not None:
        checks.append((some & ((b > height) | (r > width)), "box ends outside of the image"))
    errors = F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in checks]))
    return labels.select("frame_index", "tracklet_id", errors.alias("errors")).where(F.size("errors") > 0)


def reviewed(labels: DataFrame) -> DataFrame:
    """labels, or an error where any row's file says that it's still to be reviewed."""
    pending = labels.where(F.lower(F.trim("status")).isin("pending", "draft", "todo", "needs_review", "unreviewed"))
    if not pending.isEmpty():
        raise ValueError("the labels are not reviewed yet")
    return labels


def parse_detector_lines(lines: DataFrame, text: str = "value", confidence: float = 1.0) -> DataFrame:
    """class_id, x, y, w, h, confidence of lines of five or six numbers, with error, null where a line is right; blank lines are left out.

    The class is a whole number of 0 or more, sizes are above 0, all are finite.
    """
    keep = [c for c in lines.columns if c != text]
    rows = lines.where(F.trim(F.col(text)) != "").withColumn("_p", F.split(F.trim(F.col(text)), r"\s+"))
    n = F.size("_p")
    numbers = [values.number(F.get("_p", F.lit(i))) for i in range(6)]
    conf = F.when(n == 5, F.lit(confidence)).otherwise(numbers[5])
    missing = F.exists(F.array(*numbers[:5], conf), lambda x: x.isNull())
    error = (
        F.when(~n.isin(5, 6), "a line has five or six numbers").when(missing, "a number is missing or not finite")
        .when((numbers[0] != F.floor(numbers[0])) | (numbers[0] < 0), "the class is a whole number").when((numbers[3] <= 0) | (numbers[4] <= 0), "width and height are above 0")
    )
    out = rows.select(*keep, numbers[0].alias("class_id"), *[numbers[i].alias(c) for i, c in enumerate("xywh", 1)], conf.alias("confidence"), error.alias("error"))
    return out.withColumn("class_id", F.when(F.col("error").isNull(), F.col("class_id").cast("long")))


def read_detector_files(spark: SparkSession, folder: str, confidence: float = 1.0) -> DataFrame:
    """Parsed lines of a folder's *.txt files, each with its file's stem; files without a number in their name are left out."""
    from loopsight.sources.images import frame_number, stem

    lines = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    lines = lines.select("value", stem(F.col("path")).alias("stem"), frame_number(F.col("path")).alias("frame_index")).where("frame_index is not null")
    return parse_detector_lines(lines, confidence=confidence)


def detector_detections(predictions: DataFrame, images: DataFrame, source: str = "detector") -> DataFrame:
    """Detections of predictions (stem, class_id, x, y, w, h, confidence) on images (stem, frame_index, width, height), numbered in each frame.

    An error for a prediction without an image, or that has nothing inside it.
    """
    met = predictions.join(images.select("stem", F.col("frame_index").alias("number"), "width", "height"), "stem", "left")
    box = boxes.pixel_box(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])
    checked = F.when(F.col("number").isNull(), F.raise_error(F.lit("a prediction has no image"))).when(box["bbox_top"].isNull(), F.raise_error(F.lit("a prediction lies outside of its image"))).otherwise(F.col("number"))
    from pyspark.sql import Window

    order = Window.partitionBy("frame_index").orderBy(F.desc("score"), "class_id", "bbox_top", "bbox_left", "bbox_bottom", "bbox_right")
    out = met.select(checked.alias("frame_index"), *[c.alias(n) for n, c in box.items()], F.col("confidence").alias("score"), "confidence", "class_id", F.lit(source).alias("source"))
    return out.withColumn("label", F.row_number().over(order).cast("long"))


def timestamps(rows: DataFrame, frame: str = "frame_index", time: str = "time_s") -> DataFrame:
    """frame_index, time_s of text rows; an error for numbers that are missing, or a frame that stands twice."""
    out = rows.select(values.whole(F.col(frame)).alias("frame_index"), values.number(F.col(time)).alias("time_s"))
    if not out.where("frame_index is null or time_s is null").isEmpty():
        raise ValueError("a frame or time is not a number")
    if not out.groupBy("frame_index").count().where("count > 1").isEmpty():
        raise ValueError("a frame stands twice")
    return out


def reused_phases(rows: DataFrame, frames: int, names: DataFrame | None = None) -> DataFrame:
    """Phase rows (frame_index, phase_px, image) that cover frames 0 to frames - 1 once each, with finite phases and the images' names; else an error."""
    phase = finite(F.col("phase_px").cast("double"))
    found = rows.agg(F.count(F.lit(1)), F.countDistinct("frame_index"), F.min("frame_index"), F.max("frame_index"), F.count(phase)).first()
    if tuple(found) != (frames, frames, 0 if frames else None, frames - 1 if frames else None, frames):
        raise ValueError("the phases don't fit the frames")
    if names is not None and not rows.join(names.select("frame_index", F.col("image").alias("_i")), "frame_index", "left").where(~F.col("image").eqNullSafe(F.col("_i"))).isEmpty():
        raise ValueError("the phases are of other images")
    return rows


def json_safe(value):
    """A value as JSON can hold it: numbers that aren't finite are null, arrays lists, paths text."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [json_safe(v) for v in value]
    if hasattr(value, "tolist"):
        return json_safe(value.tolist())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if isinstance(value, str | int | bool | None) else str(value)


def json_rows(rows: DataFrame) -> DataFrame:
    """One column `value` of JSON objects; numbers that aren't finite are null, and null fields stay."""
    safe = [finite(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("value"))


def in_order(rows: DataFrame, fields: tuple) -> DataFrame:
    """rows with exactly these columns; those missing are null."""
    return rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in fields])


def write_csv(rows: DataFrame, path: str, fields: tuple) -> None:
    """CSV files with a header, in the order of fields; null is blank, and what was there is replaced."""
    in_order(rows, fields).write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def write_detections(detections: DataFrame, frames: DataFrame, folder: str) -> None:
    """detections and detections_per_frame, which has a row for every frame."""
    from loopsight.operators.checks import detections_per_frame

    write_csv(detections, f"{folder}/detections", FIELDS["detections"])
    write_csv(detections_per_frame(frames, detections), f"{folder}/detections_per_frame", FIELDS["detections_per_frame"])


def write_json(rows: DataFrame, path: str) -> None:
    json_rows(rows).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The standard tables of a run's folder as text; those that it lacks are empty."""
    names = ("detections", "detections_per_frame", "tracks", "filtered_tracks", "velocities", "filtered_velocities", "track_scores", "phase_estimates", "photometric_fits", "events")
    out = {}
    for n in names:
        found = [p for p in (f"{folder}/{n}.csv", f"{folder}/{n}") if Path(p).exists() or "://" in folder]
        out[n] = read_csv(spark, found[0] if found else f"{folder}/{n}.csv")
    return out
