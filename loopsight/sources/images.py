"""Images as rows: listing, natural order, decoding, crops, masks; NumPy files.

A frame is (frame_index, height, width, pixels array<double> in reading order).
"""

import ast

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopsight.operators.ordered import ranks


def natural_key(name: Column) -> Column:
    """A text that sorts by the numbers in a name, not by their digits, and without regard to case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 24, "0")).otherwise(p)), "")


def frame_number(path: Column, pattern: str = r"(\d+)") -> Column:
    """The last number in a file's name, without its ending; null without any. A pattern's first group is the number."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.try_element_at(F.regexp_extract_all(stem, F.lit(pattern), 1), F.lit(-1)).try_cast("long")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def image_paths(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg,bmp,gif}", stride: int = 1, most: int | None = None) -> DataFrame:
    """path, length, frame_index of a folder's images and those below it, in natural order; each stride-th, at most so many.

    Only names are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    files = files.select("path", "length", natural_key(F.col("path")).alias("key"))
    out = ranks(files, ["key", "path"]).where(F.col("rank") % stride == 0).select("path", "length", (F.col("rank") / stride).cast("long").alias("frame_index"))
    return out.where(F.col("frame_index") < most) if most is not None else out


def images_by_stem(spark: SparkSession, folder: str, pattern: str = r"(\d+)") -> DataFrame:
    """stem, frame_index, path of a folder's images; an error where two have the same stem."""
    files = image_paths(spark, folder).select(stem(F.col("path")).alias("stem"), frame_number(F.col("path"), pattern).alias("frame_index"), "path")
    twice = files.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several images are called {twice[0]['stem']}")
    return files


def _gray():
    @F.arrow_udf("array<double>")
    def of(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for h, w, n, b in zip(*(c.to_pylist() for c in (height, width, channels, data)), strict=True):
            x = np.frombuffer(b, dtype=np.uint8).reshape(h * w, n).astype(np.int64)
            # channels lie as blue, green, red; luma in 65,536ths, rounded
            out.append((x[:, 0] if n == 1 else (x[:, 2] * 19595 + x[:, 1] * 38470 + x[:, 0] * 7471 + 32768) >> 16).astype(float))
        return pa.array(out, type=pa.list_(pa.float64()))

    return of


def decoded(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Frames of listed files (path, frame_index), as gray values; files that aren't images are left out.

    The files are listed before they are decoded, so no other file is read.
    """
    paths = [r["path"] for r in files.select("path").collect()]  # names only
    if not paths:
        return spark.createDataFrame([], "frame_index long, height int, width int, pixels array<double>")
    images = spark.read.format("image").option("dropInvalid", "true").load(paths).select("image.*")
    gray = _gray()(F.col("height"), F.col("width"), F.col("nChannels"), F.col("data"))
    plain = F.regexp_replace(F.col("origin"), r"^file:/+", "/")
    rows = images.select(plain.alias("plain"), "height", "width", gray.alias("pixels"))
    return files.select("frame_index", F.regexp_replace("path", r"^file:/+", "/").alias("plain")).join(rows, "plain").drop("plain")


def cropped(frames: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """The same part of every frame; an error where a frame is smaller."""
    w = F.col("width")
    fits = (F.lit(top + height) <= F.col("height")) & (F.lit(left + width) <= w)
    rows = F.transform(F.sequence(F.lit(top), F.lit(top + height - 1)), lambda y: F.slice("pixels", y * w + left + 1, F.lit(width)))
    part = F.when(fits, F.flatten(rows)).otherwise(F.raise_error(F.lit("the crop lies outside of a frame")))
    return frames.select(
        *[c for c in frames.columns if c not in ("height", "width", "pixels")], F.lit(height).alias("height"), F.lit(width).alias("width"), part.alias("pixels")
    )


def parse_region(text: str, height: int, width: int) -> tuple[int, int, int, int]:
    """(top, left, height, width) of a text of four whole numbers; the whole image for an empty one, an error where it doesn't fit."""
    if not text.strip():
        return 0, 0, height, width
    top, left, h, w = (int(x) for x in text.split(","))
    if top < 0 or left < 0 or h <= 0 or w <= 0 or top + h > height or left + w > width:
        raise ValueError(f"{text} does not lie in an image of {height} by {width}")
    return top, left, h, w


def pixels(frames: DataFrame, name: str = "v", column: str = "pixels") -> DataFrame:
    """frame_index, y, x, v: a row for each pixel."""
    rows = frames.select("frame_index", "width", F.posexplode(column).alias("i", name))
    return rows.select("frame_index", F.floor(F.col("i") / F.col("width")).alias("y"), (F.col("i") % F.col("width")).cast("long").alias("x"), name)


def packed(rows: DataFrame, height: int, width: int, name: str = "v") -> DataFrame:
    """Frames of pixel rows; pixels that are missing are null."""
    at = F.map_from_entries(F.collect_list(F.struct((F.col("y") * width + F.col("x")).cast("int").alias("i"), F.col(name).cast("double").alias("v"))))
    out = rows.groupBy("frame_index").agg(at.alias("at"))
    values = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: F.try_element_at("at", i))
    return out.select("frame_index", F.lit(height).alias("height"), F.lit(width).alias("width"), values.alias("pixels"))


def excluded(frames: DataFrame, height: int, width: int) -> DataFrame:
    """y, x of the pixels that a mask image (one frame) marks by a value other than 0; an error for another size."""
    wrong = frames.where((F.col("height") != height) | (F.col("width") != width))
    if not wrong.isEmpty():
        raise ValueError(f"the mask is not {height} by {width}")
    return pixels(frames).where("v <> 0").select("y", "x")


def edges(height: int, width: int, top: int = 0, bottom: int = 0, left: int = 0, right: int = 0) -> Column:
    """Whether a pixel (y, x) lies in a margin."""
    y, x = F.col("y"), F.col("x")
    return (y < top) | (y >= height - bottom) | (x < left) | (x >= width - right)


def without(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixel rows that a mask (y, x) doesn't mark."""
    return rows.join(mask.select("y", "x").distinct(), ["y", "x"], "left_anti")


def filled(rows: DataFrame, mask: DataFrame, name: str = "v", value: float | None = None) -> DataFrame:
    """Pixel rows, those marked with another value, null if none is given."""
    marked = mask.select("y", "x").distinct().withColumn("_m", F.lit(True))
    new = F.lit(value).cast("double")
    return rows.join(marked, ["y", "x"], "left").withColumn(name, F.when(F.col("_m"), new).otherwise(F.col(name))).drop("_m")


def parse_npy(content: bytes) -> np.ndarray:
    """The array of an NPY file; arrays of Python objects are refused."""
    if content[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    size = 2 if content[6] == 1 else 4
    begin = 8 + size
    length = int.from_bytes(content[8:begin], "little")
    header = ast.literal_eval(content[begin : begin + length].decode("latin-1"))
    kind = np.dtype(header["descr"])
    if kind.hasobject:
        raise ValueError("the array holds objects")
    return np.frombuffer(content, dtype=kind, offset=begin + length).reshape(header["shape"], order="F" if header["fortran_order"] else "C")


def read_npy(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """path, belt_row, x, v of the NPY files at a path, two dimensions each; values that aren't finite are null.

    A file's rows leave its task one at a time. An error for another shape than is asked for.
    """

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = parse_npy(content)
                if a.ndim != 2 or (shape is not None and a.shape != tuple(shape)):
                    raise ValueError(f"{name} has shape {a.shape}")
                for y, row in enumerate(a.astype(float)):
                    v = pa.array(row, mask=~np.isfinite(row))
                    columns = [pa.array([name] * len(row)), pa.array(np.full(len(row), y)), pa.array(np.arange(len(row))), v]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "belt_row", "x", "v"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, "path string, belt_row long, x long, v double")


def image_header(content: bytes) -> dict:
    """Format, width, height and mode of a PNG, GIF, BMP or JPEG file, from its header; null where it's another."""
    none = {"format": None, "width": None, "height": None, "mode": None}
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 26:
        modes = {0: "gray", 2: "rgb", 3: "palette", 4: "gray+alpha", 6: "rgba"}
        return {"format": "PNG", "width": int.from_bytes(content[16:20]), "height": int.from_bytes(content[20:24]), "mode": modes.get(content[25])}
    if content[:4] == b"GIF8" and len(content) >= 10:
        return {"format": "GIF", "width": int.from_bytes(content[6:8], "little"), "height": int.from_bytes(content[8:10], "little"), "mode": "palette"}
    if content[:2] == b"BM" and len(content) >= 30:
        w, h = (int.from_bytes(content[i : i + 4], "little", signed=True) for i in (18, 22))
        return {"format": "BMP", "width": w, "height": abs(h), "mode": "palette" if content[28] <= 8 else "rgb"}
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4])
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                mode = {1: "gray", 3: "rgb", 4: "cmyk"}.get(content[at + 9])
                return {"format": "JPEG", "width": int.from_bytes(content[at + 7 : at + 9]), "height": int.from_bytes(content[at + 5 : at + 7]), "mode": mode}
            at += 2 + size
    return none


def image_metadata(files: DataFrame) -> DataFrame:
    """path, length, format, width, height, mode of binary files (path, length, content); the content isn't decoded."""
    kind = pa.struct([("format", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("mode", pa.string())])

    @F.arrow_udf("format string, width long, height long, mode string")
    def header(content: pa.Array) -> pa.Array:
        return pa.array([image_header(x or b"") for x in content.to_pylist()], type=kind)

    return files.select("path", "length", header("content").alias("h")).select("path", "length", "h.*")
