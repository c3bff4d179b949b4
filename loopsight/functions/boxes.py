"""Column geometry of half-open boxes and the scores built on counts of matches."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("top", "left", "bottom", "right")


def sides(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{s}") for s in SIDES)


def area(box: tuple) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0)) * F.greatest(box[3] - box[1], F.lit(0))


def overlap(a: tuple, b: tuple) -> Column:
    height = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    width = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(height, F.lit(0)) * F.greatest(width, F.lit(0))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    """1 without any detection or truth, 0 without detections where there is truth."""
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.when(fn == 0, 1.0).otherwise(0.0))


def recall(tp: Column, fp: Column, fn: Column) -> Column:
    """1 without any truth or detection, null without truth where there are detections."""
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.when(fp == 0, 1.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).when((p == 0) & (r == 0), 0.0)


def middle(box: tuple) -> tuple[Column, Column]:
    """(y, x) of the middle pixel of a half-open box."""
    return (box[0] + box[2] - 1.0) * 0.5, (box[1] + box[3] - 1.0) * 0.5


def centre(box: tuple, y: Column, x: Column) -> tuple[Column, Column]:
    """The given centroid, or the box's middle where either coordinate is missing."""
    known = y.isNotNull() & x.isNotNull()
    a, b = middle(box)
    return F.when(known, y).otherwise(a), F.when(known, x).otherwise(b)


def distance(a: tuple, b: tuple) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def diagonal(box: tuple) -> Column:
    return F.hypot(F.greatest(box[2] - box[0], F.lit(0)), F.greatest(box[3] - box[1], F.lit(0)))


def containment(a: tuple, b: tuple) -> Column:
    """The overlap's share of the smaller box; 0 where that is empty."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap(a, b) / least).otherwise(0.0)


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """A detector's box, centre and size as shares of the image, as a clipped box of whole pixels; all null where nothing is left.

    The centroid is that of the clipped box; edges go outwards to whole pixels, and the area is theirs.
    """
    edge = lambda at, size: F.least(F.greatest(at, F.lit(0.0)), size.cast("double"))
    left, right = edge((x - w / 2) * width, width), edge((x + w / 2) * width, width)
    top, bottom = edge((y - h / 2) * height, height), edge((y + h / 2) * height, height)
    some = (right > left) & (bottom > top)
    out = {"bbox_top": F.floor(top), "bbox_left": F.floor(left), "bbox_bottom": F.ceil(bottom), "bbox_right": F.ceil(right)}
    size = (out["bbox_bottom"] - out["bbox_top"]) * (out["bbox_right"] - out["bbox_left"])
    out |= {"y": (top + bottom) * 0.5, "x": (left + right) * 0.5, "area_px": size}
    return {name: F.when(some, column) for name, column in out.items()}
